"""Global order without a single-partition sort.

Rows are range-partitioned on the full (unique) order key, so ties on a
leading column spread as well, and sorted inside their partition. One table in
the shared folder pins that layout; per-partition totals then give every partition
its starting offset. Only the totals, one row per partition and key, are ever
seen by an unpartitioned window.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.session import sized

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def lay_out(df: DataFrame, order_by, keep=("*",)) -> DataFrame:
    """``df``, or its columns ``keep``, in global order with its range partition and index inside it."""
    placed = sized(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .select(*keep, F.monotonically_increasing_id().alias("_row"))
    )
    return (
        placed.withColumn("_part", F.shiftright("_row", _LOCAL_BITS))
        .withColumn("_index", F.col("_row").bitwiseAND(F.lit(_LOCAL_MASK)))
        .drop("_row")
    )


def running_totals(df: DataFrame, order_by, sums=None, partition_by=(), position=None, keep=("*",), where=None) -> DataFrame:
    """Exclusive running sums and 1-based positions in a global order.

    ``order_by`` must identify a row inside each ``partition_by`` key. ``sums``
    maps an output name to the numeric column summed over the preceding rows
    of the same key. A key holding most of the rows still spans many range
    partitions, so no task ever sees all of it. ``where`` picks the rows to return;
    the others, which must add 0 to every sum, count for positions but meet no window.
    """
    sums = dict(sums or {})
    keys = list(partition_by)
    laid = lay_out(df, [F.col(k) for k in keys] + list(order_by), keep)

    inside = Window.partitionBy("_part", *keys).orderBy("_index")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_index").alias("_first"),
        *[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()],
    )
    earlier = (
        Window.partitionBy(*keys) if keys else Window.partitionBy()
    ).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}")
            for name in sums
        ],
    )
    # One row per range partition, plus one per key that starts inside one.
    offsets = sized(offsets)

    local = laid.filter(where) if where is not None else laid
    for name, value in sums.items():
        local = local.withColumn(
            f"_local_{name}", F.coalesce(F.sum(value).over(before), F.lit(0))
        )
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(offsets, on)
    if position:
        joined = joined.withColumn(position, F.col("_index") + F.col("_shift") + 1)
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_local_{name}") + F.col(f"_base_{name}"))
    return joined.drop(
        "_part",
        "_index",
        "_p",
        "_shift",
        *[f"_k_{k}" for k in keys],
        *[f"_{kind}_{name}" for kind in ("local", "base") for name in sums],
    )
