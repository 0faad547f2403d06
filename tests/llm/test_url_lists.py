from datetime import datetime, timedelta

from pyspark.sql import functions as F

from annotary.llm import catalog, url_lists
from tests.check_oracle import compare, connect
from tests.conftest import SF_DIR

DAY = datetime(2024, 1, 1)
ENTRY = "list string, pattern string, ts timestamp, seq long, active boolean"


def at(hours):
    return DAY + timedelta(hours=hours)


def test_entries_hold_until_the_next_one_and_specific_patterns_decide(spark):
    entries = spark.createDataFrame(
        [
            ("block", "bad.org", at(1), 1, True), ("block", "bad.org", at(5), 2, False), ("block", "bad.org", at(5), 3, True),
            ("block", "bad.org", at(9), 4, False), ("allow", "ok.bad.org", at(2), 5, True), ("allow", "tie.net", at(0), 6, True),
            ("block", "tie.net", at(0), 7, True), (None, "x.org", at(0), 8, True), ("block", None, at(0), 9, True), ("block", "x.org", None, 9, True),
        ],
        ENTRY,
    )
    asked = [
        ("http://bad.org/a", 0, True), ("http://bad.org/a", 1, False), ("https://u@WWW.Bad.org:80/a", 4, False), ("http://bad.org", 5, False),
        ("http://bad.org", 9, True), ("http://a.ok.bad.org/", 3, True), ("http://ok.bad.org/", 1, False), ("http://tie.net", 1, True),
        ("http://x.org", 3, True), ("no url", 3, True), (None, 3, True), ("http://bad.org/a", None, True),
    ]
    rows = [(u, None if h is None else at(h), want) for u, h, want in asked] * 2
    captures = spark.createDataFrame(rows, "url string, fetched timestamp, list boolean")
    got = url_lists.filter_urls(captures, entries).collect()
    assert len(got) == len(rows) and all(r.kept == r.list for r in got), [r for r in got if r.kept != r.list]


def test_a_hot_pattern_spreads_and_stays_exact(spark):
    entries = spark.range(3000).select(
        F.lit("block").alias("list"), F.lit("hot.org").alias("pattern"), F.timestamp_seconds(F.col("id") * 10).alias("ts"),
        F.col("id").alias("seq"), (F.col("id") % 3 > 0).alias("active"),
    )
    captures = spark.range(5000).select(F.lit("http://hot.org/").alias("url"), F.timestamp_seconds(F.col("id") * 7 - 50).alias("fetched"))
    got = url_lists.filter_urls(captures, entries).selectExpr("unix_seconds(fetched) AS s", "kept").collect()
    assert all(r.kept == (r.s < 0 or min(r.s // 10, 2999) % 3 == 0) for r in got) and len(got) == 5000


def test_empty_tables(spark):
    captures = spark.createDataFrame([("http://a.org", at(1))], "url string, fetched timestamp")
    entries = spark.createDataFrame([], ENTRY)
    assert [r.kept for r in url_lists.filter_urls(captures, entries).collect()] == [True]
    assert url_lists.filter_urls(captures.limit(0), entries).count() == 0


def test_query_equals_sql(spark):
    query = catalog.load()["op5_url_asof"]
    assert compare(query.run(spark, SF_DIR), connect(SF_DIR), query.sql) is None
