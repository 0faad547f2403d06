"""Streams over files that grow, arrive late or arrive twice; each equals its batch."""

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from annotary.operators import scored as m
from annotary.plans import catalog_runs as runs
from annotary.plans import standin
from annotary.plans.catalog import query
from annotary.plans.catalog_scored import _SCORED, K, _scored_of
from annotary.session import scratch_path
from annotary.sources.run_files import finished_runs
from annotary.sources.tail import file_system, tail_events
from annotary.streaming import progress as live_progress
from annotary.streaming import scored as live
from annotary.streaming import sessions as live_sessions
from annotary.streaming.sinks import drain_append, drain_complete, drain_update, new_place, rocksdb_state


@query(f"""WITH {runs._PROGRESS}
SELECT run, iteration, loss, iterations, round(percent, 6) AS percent,
  round(rate, 6) AS seconds_per_iteration, round(seconds_left, 4) AS seconds_left FROM progress""")
def stream_progress_eta(spark, sf_dir):
    """Percent and time left of every run, from event files that land one after the other."""
    events = runs._events(spark, sf_dir)
    path = scratch_path(spark, "landed")
    events.repartition(4).write.json(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).json(path)
    targets = events.groupBy("run").agg(
        (F.count(F.lit(1)) * 30.0).alias("elapsed_seconds"), F.lit(200_000).alias("iterations")
    )
    p = drain_update(live_progress.live_progress(stream, targets), "progress", ["run"])
    return p.select(
        "run",
        "iteration",
        "loss",
        "iterations",
        F.round("percent", 6).alias("percent"),
        F.round("seconds_per_iteration", 6).alias("seconds_per_iteration"),
        F.round("seconds_left", 4).alias("seconds_left"),
    )


def _append_lines(lines, root):
    """Append (file, value) rows to the files below ``root``, in the order of the partition."""

    def append(batches):
        system, base = file_system(root)
        n = 0
        for batch in batches:
            rows = batch.to_pylist()
            for file in dict.fromkeys(r["file"] for r in rows):
                path = f"{base}/{file}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                there = system.get_file_info(path).type == fs.FileType.File
                with system.open_append_stream(path) if there else system.open_output_stream(path) as out:
                    out.write("".join(r["value"] for r in rows if r["file"] == file).encode())
            n += len(rows)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    lines.select("file", "value").mapInArrow(append, "n long").agg(F.sum("n")).collect()


@query("""WITH runs AS (SELECT c_mktsegment AS campaign, 'nation-' || c_nationkey AS run, c_nationkey AS k,
    count(*) AS n, max(c_custkey) AS best, sum(c_custkey) AS total FROM customer GROUP BY ALL)
SELECT campaign, run, CAST(42 + k % 3 AS INTEGER) AS seed, CASE WHEN k % 5 = 0 THEN 'baseline' ELSE 'unet' END AS model,
  k % 2 = 1 AS copy_paste, CAST(1 + k % 2 AS INTEGER) AS n_corpus, CAST(n AS INTEGER) AS num_train_images,
  CAST(best AS INTEGER) AS best_iteration, CAST(total AS DOUBLE) AS elapsed_seconds
FROM runs WHERE k % 4 > 0 AND k <> 7""")
def run_directory_scan(spark, sf_dir):
    """A folder a run; some have no summary yet, one has no config, and none of those is a result."""
    k = F.col("c_nationkey")
    runs_ = standin.table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("best"), F.sum("c_custkey").alias("total")
    )
    config = F.struct(
        (42 + k % 3).alias("seed"),
        F.when(k % 5 == 0, "baseline").otherwise("unet").alias("model"),
        F.when(k % 2 == 1, True).alias("copy_paste"),
        F.when(k % 2 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("corpus"),
    )
    summary = F.struct(
        F.lit(0).alias("seed"),
        F.col("n").alias("num_train_images"),
        F.col("best").alias("best_iteration"),
        F.col("total").cast("double").alias("elapsed_seconds"),
    )
    folder = F.concat_ws("/", F.col("c_mktsegment"), F.concat(F.lit("nation-"), k.cast("string")))
    root = scratch_path(spark, "runs")
    for name, row, test in (("config", config, k != 7), ("summary", summary, k % 4 > 0)):
        files = runs_.filter(test).select(F.concat(folder, F.lit(f"/{name}.json")).alias("file"), F.to_json(row).alias("value"))
        _append_lines(files.repartition("file"), root)
    return finished_runs(spark, root).select(
        "campaign", "run", "seed", "model", "copy_paste", "n_corpus", "num_train_images", "best_iteration", "elapsed_seconds"
    )


@query("""WITH log AS (SELECT 'run' || user_id % 16 AS run, CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'val'
    ELSE event_type END AS type, event_id AS iteration, value AS loss FROM events)
SELECT run, type, count(*) AS n, max(iteration) AS iteration, round(sum(loss), 4) AS loss FROM log GROUP BY 1, 2""")
def event_log_tail(spark, sf_dir):
    """Sixteen logs that grow between two triggers, each with a half-written last line at the first."""
    events = runs._events(spark, sf_dir)
    number = F.regexp_extract("run", r"(\d+)$", 1).cast("long") % 16
    events = events.withColumn("run", F.concat(F.lit("run"), number.cast("string")))
    half = events.agg((F.max("iteration") / 2).cast("long")).first()[0] or 0
    text = F.concat(F.to_json(F.struct("type", "iteration", "loss")), F.lit("\n"))
    # of every run's first event of the second half, the beginning is written in the first
    torn = events.filter(F.col("iteration") > half).groupBy("run").agg(F.min("iteration").alias("torn"))
    rows = events.join(torn, "run", "left").withColumn("text", text)
    is_torn = F.coalesce(F.col("iteration") == F.col("torn"), F.lit(False))
    early = rows.filter((F.col("iteration") <= half) | is_torn).withColumn(
        "value", F.when(is_torn, F.left("text", F.lit(9))).otherwise(F.col("text"))
    )
    late = rows.filter(F.col("iteration") > half).withColumn(
        "value", F.when(is_torn, F.expr("substring(text, 10)")).otherwise(F.col("text"))
    )
    root, place = scratch_path(spark, "logs"), new_place(spark, "tailed")
    for part in (early, late):
        file = F.concat(F.lit("campaign/"), F.col("run"), F.lit("/events.jsonl"))
        _append_lines(part.withColumn("file", file).repartition("file").sortWithinPartitions("file", "iteration"), root)
        table = drain_append(tail_events(spark, root, rangeBytes=4096), "tailed", place)
    return table.groupBy("run", "type").agg(
        F.count(F.lit(1)).alias("n"), F.max("iteration").alias("iteration"), F.round(F.sum("loss"), 4).alias("loss")
    )


_SESSIONS = """WITH flagged AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM flagged)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS session_id, CAST(min(ts) AS TIMESTAMP) AS first_ts,
  CAST(max(ts) AS TIMESTAMP) AS last_ts, count(*) AS n_events FROM numbered GROUP BY user_id, k"""


@query(_SESSIONS)
def stream_sessions_all(spark, sf_dir):
    """Sessions per user, open ones included, from files in no order of time: most rows are late and correct
    sessions that were given out before."""
    stored = standin.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "landed")
    files = -(-stored.rdd.getNumPartitions() // 3)
    for part in range(3):
        stored.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).repartition(files).write.mode("append").parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files).parquet(path)
    with rocksdb_state(spark):
        found = live_sessions.corrected_sessions(stream, ["user_id"], "event_id", "ts", "36500 days", 3600)
        newest = drain_update(found, "sessions", ["user_id", "session_id"])
    return live_sessions.current_sessions(newest).select(
        "user_id",
        "session_id",
        F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
        F.col("last_ts").cast("timestamp_ntz").alias("last_ts"),
        "n_events",
    )


@query(f"WITH {_SCORED} SELECT target, pred, n FROM confusion")
def stream_confusion_replayed(spark, sf_dir):
    """Every file is delivered twice, the second time behind the next one; no row counts twice."""
    stored = standin.table(spark, sf_dir, "lineitem").withColumn("seen_at", F.timestamp_seconds(F.col("l_orderkey") + 1_500_000_000))
    low, high = stored.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    width = max(1, ((high or 0) - (low or 0)) // 4 + 1)
    path = scratch_path(spark, "landed")

    # a delivery is a quarter of the table, in files enough that no task takes more of a larger table
    files = -(-stored.rdd.getNumPartitions() // 4)

    def land(part):
        rows = stored.filter(F.call_function("div", F.col("l_orderkey") - low, F.lit(width)) == part)
        rows.repartition(files).write.mode("append").parquet(path)

    for part in (0, 1, 0, 2, 1, 3, 2, 3):
        land(part)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 2 * files).parquet(path)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    fresh = live.once(stream, keys, "seen_at", f"{3 * width} seconds")
    with rocksdb_state(spark):  # the keys of all rows within the delay
        counts = drain_complete(live.running_confusion(_scored_of(fresh), K), "confusion")
    return m.complete_grid(counts, K)
