import hashlib
import math

import pytest
from pyspark.sql import functions as F

from annotary.checks import CorpusError, LeakError
from annotary.operators import intervals, ordered, sampling, sessions, split

SCHEMA = "image_id string, group_id string, split_hint string, n_instances long"


def corpus(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sequential_split(rows, seed, fractions=split.DEFAULT_FRACTIONS, strata=3):
    """The assignment walked through one group at a time."""
    images, total = {}, {}
    for _, gid, _, n in rows:
        images[gid] = images.get(gid, 0) + 1
        total[gid] = total.get(gid, 0) + n
    by_density = sorted(images, key=lambda gid: (total[gid] / images[gid], gid))
    out = {}
    for s in range(strata):
        part = [g for i, g in enumerate(by_density) if i * strata // len(by_density) == s]
        part.sort(key=lambda gid: (hashlib.sha256(f"{seed}:{gid}".encode()).hexdigest()[:16], gid))
        size = sum(images[gid] for gid in part)
        limits, reached = [], 0.0
        for share in fractions.values():
            reached += share * size
            limits.append(reached)
        placed = 0
        for gid in part:
            k = next((k for k, x in enumerate(limits[:-1]) if placed < x), len(limits) - 1)
            out[gid] = list(fractions)[k]
            placed += images[gid]
    return out


ROWS = [(f"img{g}-{k}", f"session-{g:04d}", None, 1 + g % 5) for g in range(120) for k in range(1 + g % 4)]


def assigned(df):
    return {r["group_id"]: r["split"] for r in df.select("group_id", "split").distinct().collect()}


def test_equals_sequential_walk(spark):
    done = split.group_split(corpus(spark, ROWS), seed=42)
    assert done.count() == len(ROWS)
    assert assigned(done) == sequential_split(ROWS, 42)


@pytest.mark.parametrize("per_bucket", [1, 7])
def test_many_hash_buckets_change_nothing(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(split, "hex_digits", lambda n: 2 if per_bucket == 1 else 1)
    assert assigned(split.group_split(corpus(spark, ROWS), seed=5)) == sequential_split(ROWS, 5)


def test_partition_invariance(spark):
    results = []
    for n in ("1", "16"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(assigned(split.group_split(corpus(spark, ROWS).repartition(int(n)), seed=3)))
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_fractions_seed_and_stratification(spark):
    rows = [(f"i{g}", f"g{g:03d}", None, 1 if g < 150 else 12) for g in range(300)]
    done = split.group_split(corpus(spark, rows), seed=0)
    shares = {r["split"]: (r["n"], r["d"]) for r in done.groupBy("split").agg(
        F.count("*").alias("n"), F.avg("n_instances").alias("d")).collect()}
    for name, share in split.DEFAULT_FRACTIONS.items():
        assert abs(shares[name][0] / 300 - share) <= 0.05
        assert abs(shares[name][1] - 6.5) <= 0.35 * 6.5
    assert assigned(done) != assigned(split.group_split(corpus(spark, rows), seed=1))
    with pytest.raises(ValueError):
        split.check_fractions({"train": 0.8, "val": 0.6})
    with pytest.raises(ValueError):
        split.check_fractions({"train": 1.5, "val": -0.5})


def test_official_hints(spark):
    hints = ["train"] * 40 + ["val"] * 10 + ["test"] * 10 + [None] * 40
    rows = [(f"i{k}", f"g{k:03d}", h, 1) for k, h in enumerate(hints)]
    done = {r["group_id"]: r["split"] for r in split.group_split(
        corpus(spark, rows), seed=0, keep_official=True).collect()}
    assert all(done[f"g{k:03d}"] == h for k, h in enumerate(hints) if h)
    assert len(done) == 100
    odd = corpus(spark, [("a", "g", "elsewhere", 1), ("b", "h", "train", 1)])
    kept = {r["group_id"]: r["split"] for r in split.group_split(odd, keep_official=True).collect()}
    assert kept["h"] == "train" and kept["g"] in split.DEFAULT_FRACTIONS
    for second in ("val", None):
        mixed = corpus(spark, [("a", "g", "train", 1), ("b", "g", second, 1)])
        with pytest.raises(CorpusError, match="conflicting"):
            split.group_split(mixed, keep_official=True)
        assert split.group_split(mixed, keep_official=False).count() == 2


def test_leak_check(spark):
    leaky = spark.createDataFrame([("g", "train"), ("g", "val"), ("h", "val")], "group_id string, split string")
    assert [r["splits"] for r in split.find_leaks(leaky).collect()] == ["train|val"]
    with pytest.raises(LeakError):
        split.require_no_leak(leaky)
    split.require_no_leak(leaky.filter("group_id = 'h'"))


def test_running_totals_with_a_hot_key(spark):
    rows = [("hot" if k % 3 else "cold", k, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, k int, v int").repartition(5)
    got = ordered.running_totals(df, [F.col("k")], {"before": "v"}, ["key"], "pos").collect()
    seen = {}
    for key, k, v in rows:
        seen.setdefault(key, []).append((k, v))
    for r in got:
        earlier = [v for k, v in seen[r["key"]] if k < r["k"]]
        assert r["pos"] == len(earlier) + 1 and r["before"] == sum(earlier)


def test_sessions(spark):
    names = [
        "02012020_081342", "02012020_081343", "02012020_081348", "02012020_100000", "IMG_0042.jpg",
        "05012020_000000", "05012020_000100", "05012020_000201",  # 60 s merges, 61 s does not
        "20200108_120000", "08012020_120000",  # one instant in both forms
        "09012020_235930", "10012020_000010",  # across midnight
    ]
    df = spark.createDataFrame([(n, n) for n in names + names[:2]], "name string, group_id string")
    got = {r["name"]: r["group_id"] for r in sessions.merge_session_groups(df).collect()}
    head = "02012020_081342"
    assert [got[n] for n in names[:5]] == [head, head, head, "02012020_100000", "IMG_0042.jpg"]
    assert [got[n] for n in names[5:8]] == ["05012020_000000", "05012020_000000", "05012020_000201"]
    assert got["20200108_120000"] == got["08012020_120000"] == "08012020_120000"
    assert got["10012020_000010"] == "09012020_235930"
    chain = spark.createDataFrame([(k, k * 60_000_000) for k in range(500)], "id long, us long")
    assert {r[0] for r in sessions.merge_sessions(chain, "id", "us").select("session_id").collect()} == {0}


def test_zero_gap_merges_only_equal_instants(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "id long, us long")
    got = {r["id"]: r["session_id"] for r in sessions.merge_sessions(df, "id", "us", gap_seconds=0).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_thumbnails(spark):
    rows = [("/a/18.jpg", "g18", 0), ("/a/Thumbnail18.jpg", "t", 1), ("/a/ThumbnailX.jpg", "x", 2), ("/b/18.jpg", "last", 3)]
    df = spark.createDataFrame(rows, "file_path string, group_id string, n int")
    got = {r["file_path"]: r["group_id"] for r in sessions.link_thumbnails(df, "n").collect()}
    assert got == {"/a/18.jpg": "g18", "/a/Thumbnail18.jpg": "last", "/a/ThumbnailX.jpg": "x", "/b/18.jpg": "last"}


def test_samples(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").cast("string").alias("image_id"), (F.col("id") % 6).alias("n_instances"))

    def ids(frame):
        return {r["image_id"] for r in frame.collect()}

    small, large = ids(sampling.seeded_subset(df, 10, 1)), ids(sampling.seeded_subset(df, 30, 1))
    assert len(small) == 10 and small < large and small != ids(sampling.seeded_subset(df, 10, 2))
    assert ids(sampling.seeded_subset(df, 0, 1)) == set() and len(ids(sampling.seeded_subset(df, 999, 1))) == 100
    first = df.withColumn("_hash", sampling.seeded_hash(1, "image_id")).orderBy("_hash", "image_id").limit(30)
    assert ids(first) == large
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 2)
    assert ids(sampling.seeded_subset(df, 30, 1)) == large
    assert all(r["n_instances"] >= 4 for r in sampling.density_sample(df, 5, 0, 4).collect())
    with pytest.raises(ValueError, match="has only|has"):
        sampling.density_sample(df, 90, 0, 2, 2)
    assert math.isclose(len(ids(sampling.density_sample(df, 5, 0, 2, 2))), 5)


def test_rows_with_null_keys_stay(spark):
    events = spark.createDataFrame([(1, None, 0), (2, None, 10**6), (3, "u", 5 * 10**6), (4, None, 200 * 10**6)], "id long, user string, us long")
    got = {r["id"]: r["session_id"] for r in sessions.merge_sessions(events, "id", "us", ["user"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    images = corpus(spark, ROWS).withColumn("group_id", F.when(F.col("group_id") != ROWS[0][1], F.col("group_id")))
    done = split.group_split(images, seed=42)
    assert done.count() == len(ROWS) and done.filter("group_id is null and split is not null").count() > 0
    files = spark.createDataFrame([(None, "g", 0), ("/a/Thumbnail1.jpg", "t", 1)], "file_path string, group_id string, n int")
    assert sorted(r["group_id"] for r in sessions.link_thumbnails(files, "n").collect()) == ["g", "t"]


def test_every_fault_of_the_shares_is_named():
    with pytest.raises(ValueError, match="val is below zero.*add up to 1.3"):
        split.check_fractions({"train": 1.5, "val": -0.2})


def test_interval_lookup(spark):
    bounds = [(None, 0, "low"), (3, 5, "a"), (6, 6, "b"), (10, None, "high")]
    table = spark.createDataFrame(bounds, "lo int, hi int, label string")
    values = [-7, 0, 1, 3, 5, 5, 5, 6, 7, 10, 99, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, x int").repartition(3)

    def label(v):
        return next((n for lo, hi, n in bounds if v is not None and (lo is None or v >= lo) and (hi is None or v <= hi)), None)

    got = {r["id"]: r["label"] for r in intervals.interval_lookup(rows, "x", table, how="left").collect()}
    assert got == {k: label(v) for k, v in enumerate(values)}
    got = {r["id"]: r["label"] for r in intervals.interval_lookup(rows, "x", table).collect()}
    assert got == {k: label(v) for k, v in enumerate(values) if label(v)}
    assert intervals.interval_lookup(rows, "x", table.limit(0)).count() == 0
    assert intervals.interval_lookup(rows.limit(0), "x", table).count() == 0
    twice = table.union(spark.createDataFrame([(5, 8, "c")], table.schema))
    with pytest.raises(Exception, match="intervals overlap at 5"):
        intervals.interval_lookup(rows, "x", twice).collect()


def test_interval_lookup_carries_over_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7 + 100).alias("x"))  # few, hot values
    table = spark.createDataFrame([(0, 102, "a"), (103, 200, "b")], "lo long, hi long, label string")
    got = {r["label"]: r["count"] for r in intervals.interval_lookup(rows, "x", table).groupBy("label").count().collect()}
    assert got == {"a": sum(k % 7 <= 2 for k in range(5000)), "b": sum(k % 7 > 2 for k in range(5000))}
