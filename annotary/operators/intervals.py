"""Which interval a value lies in, for any number of intervals.

Interval starts and values are put in one global order. The last start before
a value is its only candidate, and across a range partition's border one
carried row a partition is enough, so neither many intervals nor many equal
values meet in one task, and no pair is tried in vain.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.checks import stop_if
from annotary.operators.ordered import lay_out
from annotary.session import sized


def interval_lookup(rows: DataFrame, value: str, intervals: DataFrame, lo="lo", hi="hi", how="inner") -> DataFrame:
    """``rows`` with the other columns of the interval that holds ``value``, both bounds included.

    A null ``lo`` or ``hi`` leaves that side open. Intervals must not overlap:
    two that do stop the job. Rows outside every interval, or with a null
    value, are left out, or with ``how="left"`` kept with nulls.
    """
    given = [c for c in intervals.columns if c not in (lo, hi)]
    marks = intervals.select(
        F.col(lo).alias("_x"), F.lit(0).alias("_kind"), F.struct(F.col(hi).alias("hi"), F.struct(*given).alias("given")).alias("_mark")
    )
    spread = F.xxhash64(*rows.columns)  # equal values of a hot key still fall into many ranges
    asked = rows.filter(F.col(value).isNotNull()).select(
        F.col(value).alias("_x"), F.lit(1).alias("_kind"), F.struct("*").alias("_asked"), spread.alias("_spread")
    )
    laid = lay_out(marks.unionByName(asked, allowMissingColumns=True), [F.col("_x"), F.col("_kind"), F.col("_spread")])

    place = F.when(F.col("_mark").isNotNull(), F.col("_index"))
    ends = laid.groupBy("_part").agg(F.max_by("_mark", place).alias("_mark"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range partition
    carried = sized(ends.select("_part", F.last("_mark", ignorenulls=True).over(earlier).alias("_carried")))
    inside = Window.partitionBy("_part").orderBy("_index")
    before = F.last("_mark", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    met = laid.withColumn("_before", before).join(carried, "_part").withColumn("_last", F.coalesce("_before", "_carried"))

    reaches = F.col("_last").isNotNull() & (F.col("_last.hi").isNull() | (F.col("_last.hi") >= F.col("_x")))
    overlap = reaches | (F.col("_last").isNotNull() & F.col("_x").isNull())
    message = F.concat(F.lit("intervals overlap at "), F.coalesce(F.col("_x").cast("string"), F.lit("their open start")))
    wanted = F.lit(True) if how == "left" else reaches
    found = met.filter(F.when(F.col("_kind") == 0, stop_if(overlap, message, F.lit(False))).otherwise(wanted))
    out = found.select("_asked.*", *[F.when(reaches, F.col("_last.given")[c]).alias(c) for c in given])
    if how == "left":
        out = out.unionByName(rows.filter(F.col(value).isNull()), allowMissingColumns=True)
    return out
