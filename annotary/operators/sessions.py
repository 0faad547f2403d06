"""Sessions of neighbouring time stamps, and thumbnail twins.

A time bucket as wide as the session gap can never contain a session break,
so a plain aggregate per bucket (first id, first and last instant) is enough:
raw rows are combined before the shuffle, never put in global order, and a
crowded minute sends no more than a quiet one. Session heads are then carried forward over the bucket table in two
levels of roughly equal size, so no window spans the whole time axis.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.functions.naming import THUMBNAIL_PREFIX, basename, group_micros
from annotary.session import evaluate_once, join_null_safe, pinned

# Fixed value: time stamps at most this far apart belong to one session.
SESSION_GAP_SECONDS = 60


def session_heads(stamped: DataFrame, keys=(), gap_seconds=SESSION_GAP_SECONDS) -> DataFrame:
    """Per (keys, time bucket) the id that opens the bucket's session.

    ``stamped`` has ``id`` and ``ts`` (and ``keys``). A gap of exactly
    ``gap_seconds`` still merges; the head is the smallest ``(ts, id)``.
    """
    keys = list(keys)
    gap = int(round(gap_seconds * 1_000_000))
    width = max(gap, 1)
    buckets = pinned(
        stamped.select(*keys, "id", _clock(stamped, "ts").alias("us"))
        .withColumn("bucket", _div(F.col("us"), width))
        .groupBy(*keys, "bucket")
        .agg(
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.min(F.struct("us", "id")).alias("opener"),
        )
    )
    lo, hi = buckets.agg(F.min("bucket"), F.max("bucket")).first()
    span = (hi - lo + 1) if lo is not None else 1
    era_width = max(1, math.isqrt(span))

    # Only the bucket right before can be within the gap of a bucket's start.
    previous = buckets.select(
        *keys,
        (F.col("bucket") + 1).alias("bucket"),
        F.col("last_us").alias("previous_us"),
    )
    flagged = join_null_safe(buckets, previous, [*keys, "bucket"], "left").select(
        *keys,
        "bucket",
        _div(F.col("bucket"), era_width).alias("era"),
        F.when(
            F.col("previous_us").isNull() | (F.col("first_us") - F.col("previous_us") > gap),
            F.col("opener"),
        ).alias("head"),
    )
    upto = Window.unboundedPreceding
    in_era = Window.partitionBy(*keys, "era").orderBy("bucket").rowsBetween(upto, 0)
    by_era = Window.partitionBy(*keys).orderBy("era").rowsBetween(upto, -1)
    carried = (
        flagged.groupBy(*keys, "era")
        .agg(F.max("head").alias("era_head"))  # heads grow with time
        .select(
            *keys, "era", F.last("era_head", ignorenulls=True).over(by_era).alias("carry")
        )
    )
    own = flagged.withColumn("own", F.last("head", ignorenulls=True).over(in_era))
    return (
        join_null_safe(own, carried, [*keys, "era"])
        .select(*keys, "bucket", F.coalesce("own", "carry")["id"].alias("session_id"))
    )


def merge_sessions(df: DataFrame, id_col, ts_col, keys=(), gap_seconds=SESSION_GAP_SECONDS):
    """Add ``session_id`` to every row; a null time stamp keeps its own id.

    Rows with a null key share one timeline, as a group of a grouping would.

    Only distinct ids matter to the outcome, and repeated ones change no
    bucket aggregate, so no prior de-duplication is shuffled.
    """
    keys = list(keys)
    width = max(int(round(gap_seconds * 1_000_000)), 1)
    timed = df.filter(F.col(ts_col).isNotNull())
    heads = session_heads(
        timed.select(*keys, F.col(id_col).alias("id"), F.col(ts_col).alias("ts")),
        keys,
        gap_seconds,
    )
    placed = timed.withColumn("bucket", _div(_clock(df, ts_col), width))
    merged = join_null_safe(placed, heads, [*keys, "bucket"]).select(*df.columns, "session_id")
    untimed = df.filter(F.col(ts_col).isNull()).withColumn("session_id", F.col(id_col))
    return merged.unionByName(untimed)


def merge_session_groups(records: DataFrame, gap_seconds=SESSION_GAP_SECONDS) -> DataFrame:
    """Replace time-stamped ``group_id`` values by their session's first id."""
    stamped = evaluate_once(records, _ts=group_micros("group_id"))
    merged = merge_sessions(stamped, "group_id", "_ts", gap_seconds=gap_seconds)
    return merged.withColumn("group_id", F.col("session_id")).select(*records.columns)


def link_thumbnails(records: DataFrame, load_order="image_id") -> DataFrame:
    """Give ``Thumbnail<name>`` the group of ``<name>``; without twin, no change.

    One hop from the value before linking. Among records sharing a file name
    the last in ``load_order`` counts. Only thumbnails enter the join, so the
    other rows neither shuffle nor pile up on a null key.
    """
    named = records.withColumn("_name", basename("file_path"))
    is_thumb = F.coalesce(F.col("_name").startswith(THUMBNAIL_PREFIX), F.lit(False))
    thumbs = named.filter(is_thumb).withColumn(
        "_twin", F.substring("_name", len(THUMBNAIL_PREFIX) + 1, 1 << 30)
    )
    order = F.col(load_order) if isinstance(load_order, str) else load_order
    twins = (
        named.join(thumbs.select(F.col("_twin").alias("_name")).distinct(), "_name", "left_semi")
        .groupBy(F.col("_name").alias("_twin"))
        .agg(F.max_by("group_id", order).alias("_group"))
    )
    linked = (
        thumbs.join(twins, "_twin", "left")
        .withColumn("group_id", F.coalesce("_group", "group_id"))
        .select(*records.columns)
    )
    return named.filter(~is_thumb).select(*records.columns).unionByName(linked)


# 0001-01-01 in microseconds: clocks count from there, so none is negative.
_ORIGIN = -62_135_596_800_000_000


def _clock(df: DataFrame, ts):
    """Microseconds on the naive clock of a time stamp, or of whole
    microseconds since 1970; no session zone enters."""
    if isinstance(df.schema[ts].dataType, T.LongType):
        return F.col(ts) - _ORIGIN
    clock = F.col(ts).cast("timestamp_ntz")
    return (
        F.unix_date(F.to_date(clock)).cast("long") * 86_400_000_000
        + F.hour(clock).cast("long") * 3_600_000_000
        + F.minute(clock).cast("long") * 60_000_000
        + (F.date_part(F.lit("SECOND"), clock) * 1_000_000).cast("long")
        - _ORIGIN
    )


def _div(value, width):
    return F.call_function("div", value, F.lit(width))
