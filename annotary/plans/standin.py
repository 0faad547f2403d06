"""The driver tables read as an annotation corpus.

image := order, instance := line item, group := customer, corpus := order
priority, ring := rectangle drawn from a line item (or an embedding), time
stamp := event, run := customer, scored row := line item. Every frame covers
its whole table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.session import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark, sf_dir) -> DataFrame:
    """Orders as images; the hint is one value per customer, or null."""
    hint = (
        F.when(F.col("o_custkey") % 5 == 0, "train")
        .when(F.col("o_custkey") % 5 == 1, "val")
        .when(F.col("o_custkey") % 5 == 2, "unlisted")
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("img/"), F.col("o_orderkey").cast("string")).alias("image_id"),
        F.concat(
            F.lit("/corpus/"), F.col("o_orderstatus"), F.lit("/"),
            F.col("o_orderkey").cast("string"), F.lit(".jpg"),
        ).alias("file_path"),
        (F.col("o_custkey") % 1600 + 320).cast("int").alias("width"),
        (F.col("o_orderkey") % 1200 + 240).cast("int").alias("height"),
        F.col("o_orderpriority").alias("source"),
        hint.alias("split_hint"),
        F.concat(F.lit("grp/"), F.col("o_custkey").cast("string")).alias("group_id"),
    )


def instances(spark, sf_dir) -> DataFrame:
    """Line items as rectangles; a zero discount draws one without width."""
    x = (F.col("l_partkey") % 1000).cast("double")
    y = (F.col("l_suppkey") % 700).cast("double")
    w = F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_quantity"))
    h = (F.col("l_linenumber") * 3).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("img/"), F.col("l_orderkey").cast("string")).alias("image_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.concat("l_returnflag", "l_linestatus").alias("source_class"),
        F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h)).alias("polygon"),
        (F.col("l_tax") == 0).cast("int").alias("n_holes"),
    )


def counted_images(spark, sf_dir) -> DataFrame:
    """Images with their instance count; images without any keep 0."""
    from annotary.operators.records import with_instance_counts

    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("img/"), F.col("l_orderkey").cast("string")).alias("image_id")
    )
    return with_instance_counts(images(spark, sf_dir), lines)


def landed(spark, sf_dir, name, batches=2) -> DataFrame:
    """A table as a stream of files, in ``batches`` micro-batches, so that state is merged.

    The table lands in at least two files a batch, and in as many as it has
    partitions to read, so that no task takes more of a larger table.
    """
    stored, path = table(spark, sf_dir, name), scratch_path(spark, "landed")
    files = max(2, -(-stored.rdd.getNumPartitions() // batches))
    stored.repartition(files * batches).write.parquet(path)
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files).parquet(path)
