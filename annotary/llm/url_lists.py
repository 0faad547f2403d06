"""Temporal list join for URL filters (operator 5).

Dated entries of block and allow lists become validity intervals: an entry
holds from its date until the next entry of the same list and pattern. Every
capture is evaluated against the entries active when it was fetched.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.llm.shared import free_name, written
from annotary.operators.ordered import lay_out

LISTS = ("allow", "block")


def host_of(url):
    """Lower-case host of a URL without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def patterns_of(host):
    """The host and its parent domains of two labels or more, most specific first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return cut


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, pattern, start, stop) of the dated entries (list, pattern, ts, seq, active).

    An entry ends at the next one of its list and pattern, by (ts, seq); only
    active ones of some length are kept, and the last has no stop. Rows without
    list, pattern or date say nothing.
    """
    known = entries.filter("list is not null and pattern is not null and ts is not null")
    known = known.select("list", "pattern", "ts", "seq", F.coalesce("active", F.lit(False)).alias("active"))
    laid = lay_out(known, ["list", "pattern", "ts", "seq", "active"])
    inside = Window.partitionBy("_part").orderBy("_index")
    near = laid.withColumn("_next", F.lead(F.struct("list", "pattern", "ts")).over(inside))
    # The last row of a range partition is followed by the first of the next one: one row a partition.
    firsts = laid.groupBy("_part").agg(F.min_by(F.struct("list", "pattern", "ts"), "_index").alias("first"))
    firsts = firsts.select(F.col("_part").alias("_p"), F.lead("first").over(Window.orderBy("_part")).alias("_after"))
    near = near.join(F.broadcast(firsts), F.col("_part") == F.col("_p"))
    follow = F.coalesce("_next", "_after")
    stop = F.when((follow["list"] == F.col("list")) & (follow["pattern"] == F.col("pattern")), follow["ts"])
    out = near.select("list", "pattern", F.col("ts").alias("start"), stop.alias("stop"), "active")
    return out.filter("active and (stop is null or stop > start)").drop("active")


def active_at(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """The (list, pattern, ts) of ``asked`` (pattern, ts) that fall into an interval.

    As-of join by one global order of interval starts and questions: the last
    start at or before a question decides. Range partitions split the most
    frequent pattern as well, and only one row a partition is carried over.
    """
    names = F.array(*[F.lit(x) for x in LISTS])
    starts = spans.select("list", "pattern", F.col("start").alias("ts"), F.lit(0).alias("kind"), F.struct("start", "stop").alias("span"))
    wants = asked.select(F.explode(names).alias("list"), "pattern", "ts", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["span"].dataType).alias("span"))
    laid = lay_out(starts.unionByName(wants), ["list", "pattern", "ts", "kind"])
    upto = Window.partitionBy("_part", "list", "pattern").orderBy("_index")
    found = laid.withColumn("_span", F.last("span", ignorenulls=True).over(upto))
    tail = laid.filter("span is not null").groupBy("_part").agg(F.max_by(F.struct("list", "pattern", "span"), "_index").alias("tail"))
    parts = laid.select("_part").distinct().join(tail, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("_part").alias("_p"), F.last("tail", ignorenulls=True).over(before).alias("_tail"))
    found = found.filter("kind = 1").join(F.broadcast(carried), F.col("_part") == F.col("_p"))
    same = (F.col("_tail.list") == F.col("list")) & (F.col("_tail.pattern") == F.col("pattern"))
    span = F.coalesce("_span", F.when(same, F.col("_tail.span")))
    return found.filter(span["stop"].isNull() | (span["stop"] > F.col("ts"))).filter(span.isNotNull()).select("list", "pattern", "ts")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Every row and column of ``captures`` with host, decided_by, list and kept.

    The most specific pattern with an active entry decides; on one pattern
    allow beats block; without any the capture is kept, as are captures without
    host or fetch time. Repeated captures are evaluated once. Result columns
    whose names ``captures`` already has get underscores in front.
    """
    names = {n: free_name(captures, n) for n in ("host", "decided_by", "list", "kept")}
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("r")
    rows = captures.select(row, host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{fetched}`").alias("ts"))
    asked = rows.filter("host is not null and ts is not null").select("host", "ts").distinct()
    wide = written(asked.select("host", "ts", F.posexplode(patterns_of(F.col("host"))).alias("rank", "pattern")), "asked")
    spans = written(intervals(entries), "spans")
    hits = active_at(spans, wide.select("pattern", "ts").distinct())
    by = hits.groupBy("pattern", "ts").agg(F.min("list").alias("list"))  # allow before block
    best = wide.join(by, ["pattern", "ts"]).groupBy("host", "ts").agg(F.min(F.struct("rank", "pattern", "list")).alias("best"))
    out = rows.join(best, ["host", "ts"], "left")
    return out.select(
        *[F.col(f"r.`{c}`") for c in captures.columns],
        F.col("host").alias(names["host"]),
        F.col("best.pattern").alias(names["decided_by"]),
        F.col("best.list").alias(names["list"]),
        F.coalesce(F.col("best.list") != "block", F.lit(True)).alias(names["kept"]),
    )
