"""Seeded, exact-size, reproducible samples.

Rows are ordered by a seeded SHA-256 of their id. Any seed gives one fixed
order, so samples of growing size are nested.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.functions.naming import seeded_hash
from annotary.operators.split import hex_digits
from annotary.session import sized

BUCKET_ROWS = 10_000  # rows of the one bucket that is ranked


def seeded_subset(df: DataFrame, n_keep: int, seed: int, key="image_id") -> DataFrame:
    """Exactly ``min(n_keep, rows)`` rows; 0 is a valid request.

    The sample is cut by hash bucket, so it never passes through one task:
    whole buckets below the cut, and a rank inside the single bucket that
    straddles it.
    """
    if n_keep < 0:
        raise ValueError("n_keep must not be negative")
    hashed = df.withColumn("_hash", seeded_hash(seed, key))
    order = [F.col("_hash"), F.col(key)]
    digits = hex_digits(hashed.count(), BUCKET_ROWS)
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (  # one row a bucket
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", "_n", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
        .filter(F.col("_before") < n_keep)
    )
    chosen = bucketed.join(sized(cuts), "_bucket")
    whole = chosen.filter(F.col("_before") + F.col("_n") <= n_keep)
    partial = chosen.filter(F.col("_before") + F.col("_n") > n_keep)
    ranked = partial.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    ).filter(F.col("_rank") <= F.lit(n_keep) - F.col("_before"))
    columns = df.columns
    return whole.select(*columns).unionByName(ranked.select(*columns))


def density_filter(images: DataFrame, lo: int, hi=None) -> DataFrame:
    """``lo <= n_instances``, and ``<= hi`` unless the range is open."""
    test = F.col("n_instances") >= lo
    if hi is not None:
        test = test & (F.col("n_instances") <= hi)
    return images.filter(test)


def density_sample(images: DataFrame, n_keep: int, seed: int, lo: int, hi=None, key="image_id"):
    """Exactly ``n_keep`` images of one density range; too few is an error."""
    pool = density_filter(images, lo, hi)
    available = pool.count()
    if available < n_keep:
        raise ValueError(
            f"density range [{lo}, {'open' if hi is None else hi}] has {available} image(s), "
            f"{n_keep} asked"
        )
    return seeded_subset(pool, n_keep, seed, key)


def sample_per_source(images: DataFrame, annotated: DataFrame, n: int, seed: int, key="image_id"):
    """``n`` seeded annotated images per source.

    ``row_number() <= n`` is pruned before the shuffle, so a source holding
    most of the images sends only ``n`` rows per task.
    """
    ranked = images.join(annotated.select(key).distinct(), key, "left_semi").withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("source").orderBy(seeded_hash(seed, key), F.col(key))
        ),
    )
    return ranked.filter(F.col("rank") <= n)
