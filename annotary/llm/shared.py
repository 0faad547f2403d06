"""Small Spark helpers of the text operators."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.session import scratch_path

FILTER_BITS = 24


def with_columns_absent(df: DataFrame, *names) -> DataFrame:
    """Only the named columns, each null if the table lacks it."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])


def small_batches(spark) -> None:
    """Let Arrow batches hold at most 500 rows, so that a worker holds a few megabytes of text at a time.

    A setting of the session; the queries and the pipeline make it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bit_filter(keys: DataFrame, column: str) -> bytes:
    """A bitmap of 2**24 bits in which the bit of each 64-bit key is set.

    Always two megabytes, whatever the number of keys: at most 2**18 words
    reach the driver. A key that was put in is always found again; with very
    many keys the filter lets more through, and the join behind it decides.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = (
        keys.select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.tobytes()


def passes(bitmap: bytes, keys) -> np.ndarray:
    """Which of the 64-bit keys may be in the bitmap."""
    table = np.frombuffer(bitmap, np.uint64)
    keys = np.asarray(keys).view(np.uint64)
    slot = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder; cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(column="text"):
    """128-bit content key; equal texts have equal keys."""
    return F.md5(F.col(f"`{column}`").cast("binary"))


def texts_of(docs: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """One row (key, text) for every wanted content key.

    A two-megabyte bitmap of the keys keeps other texts from being shuffled;
    the join behind it is exact. Copies of a text fold before the shuffle.
    """
    wanted = keys.select(F.col(column).alias("key")).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("key").alias("h")), "h"))

    def select(batches):
        for batch in batches:
            keep = passes(bitmap.value, batch.column(0).to_numpy(zero_copy_only=False))
            yield batch.select([1, 2]).filter(pa.array(keep))

    found = docs.filter(F.col("text").isNotNull()).select(text_key().alias("key"), "text")
    found = found.select(F.xxhash64("key").alias("h"), "key", "text").mapInArrow(select, "key string, text string")
    return found.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node of its component.

    Alternating large and small stars: a logarithmic number of rounds, each
    written to the shared folder. A node with many neighbours is folded to a
    minimum before the shuffle and its edges may be split by adaptive joins.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s"))
        e = written(e.select("s.a", F.col("s.m").alias("b")).filter("a <> b").distinct(), "edges")
        inner = e.select("b").join(e.select(F.col("a").alias("b")), "b", "left_semi")
        if inner.isEmpty() and e.groupBy("a").count().filter("count > 1").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
