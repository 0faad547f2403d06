"""Running a stream over what has landed, into tables in the shared folder."""

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.session import scratch_path


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark):
    """Streams started inside keep their state in RocksDB, which ``transformWithState`` asks for."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def new_place(spark, name):
    """Fresh folders for a stream's table and its checkpoint."""
    return scratch_path(spark, name), scratch_path(spark, f"{name}-state")


def drain_append(stream: DataFrame, name: str, place=None) -> DataFrame:
    """Process everything available in append mode; the written table.

    ``place`` (from ``new_place``) goes on where an earlier call with it ended.
    """
    spark = stream.sparkSession
    out, state = place or new_place(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_complete(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available in complete mode; the last full table.

    Every micro-batch writes its own folder, so a reader never sees a half
    replaced table and a replayed batch overwrites only itself.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    done = []

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        done.append(batch_id)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(done)}")


def drain_update(stream: DataFrame, name: str, keys) -> DataFrame:
    """Process everything available in update mode; the newest row of every key.

    A micro-batch writes only the rows that changed, into its own folder;
    the batch number decides between rows of a key.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("_batch", T.LongType())])).parquet(f"{out}/part=*")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
    return newest.select(*keys, "_row.*").select(*stream.columns)
