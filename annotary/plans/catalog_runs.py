"""Experiment run and progress queries; also the streaming ones."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from annotary.operators import runs as r
from annotary.plans import standin
from annotary.plans.catalog import query
from annotary.session import scratch_path
from annotary.sources import sinks
from annotary.sources.run_files import run_events
from annotary.streaming import progress as live_progress
from annotary.streaming import sessions as live_sessions
from annotary.streaming.sinks import drain_append, drain_update

_RUNS = """runs AS (
  SELECT c_mktsegment AS campaign, 'run-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS run,
    CAST(42 + c_custkey % 3 AS INTEGER) AS seed,
    CASE WHEN c_nationkey % 5 = 0 THEN 'baseline' ELSE 'unet' END AS model,
    c_nationkey % 5 = 1 AS copy_paste,
    CASE c_custkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4+' WHEN 4 THEN '2-5' END AS density_bucket,
    CAST(100 * (1 + c_nationkey % 7) AS INTEGER) AS num_train_images,
    sqrt(c_acctbal + 1000) / 110 AS best_val_iou,
    CAST(3600 + c_custkey % 977 AS DOUBLE) AS elapsed_seconds,
    CAST(10000 * (1 + c_nationkey % 3) AS INTEGER) AS iterations,
    c_acctbal > 0 AS finished
  FROM customer)"""


def _configs(spark, sf_dir):
    c = standin.table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    n = key % 7
    open_end = F.lit(None).cast("int")
    bucket = (
        F.when(n == 0, F.array(F.lit(1), F.lit(1)))
        .when(n == 1, F.array(F.lit(2), F.lit(2)))
        .when(n == 2, F.array(F.lit(3), F.lit(3)))
        .when(n == 3, F.array(F.lit(4), open_end))
        .when(n == 4, F.array(F.lit(2), F.lit(5)))
    )
    return c.select(
        F.col("c_mktsegment").alias("campaign"),
        F.concat(F.lit("run-"), F.lpad(key.cast("string"), 9, "0")).alias("run"),
        (key % 3 + 42).cast("int").alias("seed"),
        F.when(nation % 5 == 0, "baseline").otherwise("unet").alias("model"),
        (nation % 5 == 1).alias("copy_paste"),
        bucket.alias("density_bucket"),
        F.array(F.lit("a.json"), F.lit("b.json")).alias("corpus"),
    )


def _summaries(spark, sf_dir):
    """Only customers in credit have finished their run."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return (
        standin.table(spark, sf_dir, "customer")
        .filter(F.col("c_acctbal") > 0)
        .select(
            F.col("c_mktsegment").alias("campaign"),
            F.concat(F.lit("run-"), F.lpad(key.cast("string"), 9, "0")).alias("run"),
            (key % 3 + 42).cast("int").alias("seed"),
            (100 * (nation % 7 + 1)).cast("int").alias("num_train_images"),
            (F.sqrt(F.col("c_acctbal") + 1000) / 110).alias("best_val_iou"),
            (key % 977 + 3600).cast("double").alias("elapsed_seconds"),
            (10000 * (nation % 3 + 1)).cast("int").alias("iterations"),
        )
    )


def _runs(spark, sf_dir):
    return r.join_runs(_summaries(spark, sf_dir), _configs(spark, sf_dir))


def _rounded(df):
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _aggregate_sql(by, where, source="runs"):
    return f"""SELECT {by}, count(DISTINCT seed) AS n_seeds, round(avg(best_val_iou), 6) AS iou_mean,
  round(stddev_samp(best_val_iou), 6) AS iou_std, round(min(best_val_iou), 6) AS iou_min,
  round(max(best_val_iou), 6) AS iou_max, round(sum(elapsed_seconds) / 3600, 6) AS gpu_hours
FROM {source} WHERE finished AND {where} GROUP BY {by}"""


@query(f"""WITH {_RUNS}
SELECT campaign, run, seed, model, copy_paste, CAST(2 AS INTEGER) AS n_corpus, density_bucket,
  num_train_images, round(best_val_iou, 6) AS best_val_iou, elapsed_seconds, iterations
FROM runs WHERE finished""")
def run_details(spark, sf_dir):
    return _rounded(r.run_details(_runs(spark, sf_dir)))


@query(f"""WITH {_RUNS} {_aggregate_sql("num_train_images, model", "TRUE")}""")
def seed_aggregate(spark, sf_dir):
    return _rounded(r.seed_aggregate(_runs(spark, sf_dir), ["num_train_images", "model"]))


@query(f"""WITH {_RUNS} {_aggregate_sql("num_train_images",
  "density_bucket IS NULL AND model = 'unet' AND NOT copy_paste")}""")
def volume_table(spark, sf_dir):
    return _rounded(r.volume_table(_runs(spark, sf_dir)))


@query(f"""WITH {_RUNS} {_aggregate_sql("num_train_images",
  "density_bucket IS NULL AND model = 'unet' AND NOT copy_paste")}""")
def csv_table(spark, sf_dir):
    """The volume table written as CSV with header and read back."""
    table = _rounded(r.volume_table(_runs(spark, sf_dir)))
    path = scratch_path(spark, "csv")
    sinks.write_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query(f"""WITH {_RUNS} {_aggregate_sql("density_bucket", "density_bucket IS NOT NULL")}""")
def density_table(spark, sf_dir):
    return _rounded(r.density_table(_runs(spark, sf_dir)))


@query(f"""WITH {_RUNS}, labelled AS (
  SELECT *, CASE WHEN model = 'baseline' THEN 'U-Net sans skips' WHEN copy_paste THEN 'Copy-Paste'
                 ELSE 'Référence (U-Net)' END AS condition FROM runs WHERE density_bucket IS NULL)
{_aggregate_sql("condition", '''num_train_images IN (SELECT num_train_images FROM labelled
  WHERE finished AND condition <> 'Référence (U-Net)')''', "labelled")}""")
def ablation_table(spark, sf_dir):
    return _rounded(r.ablation_table(_runs(spark, sf_dir)))


@query(f"""WITH {_RUNS}, counts AS (
  SELECT campaign, iterations, count(*) AS n FROM runs WHERE finished GROUP BY 1, 2)
SELECT campaign, iterations, n FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, iterations) AS k FROM counts) WHERE k = 1""")
def mode_value(spark, sf_dir):
    return r.most_frequent(_runs(spark, sf_dir), "iterations", ["campaign"])


@query(f"""WITH {_RUNS}
SELECT campaign, count(*) AS n_runs, count(DISTINCT seed) AS n_seeds,
  round(sum(elapsed_seconds) / 3600, 6) AS gpu_hours, round(avg(elapsed_seconds), 6) AS mean_run_seconds
FROM runs WHERE finished GROUP BY 1""")
def campaign_summary(spark, sf_dir):
    return _rounded(r.campaign_summary(_runs(spark, sf_dir)))


@query(f"""WITH {_RUNS}
SELECT campaign, run, round(best_val_iou, 6) AS best_val_iou, elapsed_seconds FROM runs
WHERE finished ORDER BY campaign DESC, run DESC LIMIT 5""")
def last_runs(spark, sf_dir):
    return _rounded(
        r.last_finished(_runs(spark, sf_dir)).select("campaign", "run", "best_val_iou", "elapsed_seconds")
    )


# -- planned work ------------------------------------------------------------------

_GRID = f"""{_RUNS},
points AS (SELECT DISTINCT campaign, CAST(num_train_images AS VARCHAR) AS point FROM runs
           UNION SELECT DISTINCT campaign, 'full' FROM runs),
seeds AS (SELECT DISTINCT campaign, seed FROM runs),
grid AS (SELECT points.campaign, point, seed, label,
           'n' || point || '_density' || label || '_seed' || seed AS run
         FROM points JOIN seeds USING (campaign), (VALUES ('1'), ('2'), ('3'), ('4+')) b(label)),
done AS (SELECT DISTINCT campaign, 'n' || num_train_images || '_density' || density_bucket || '_seed' || seed AS run
         FROM runs WHERE finished AND density_bucket IS NOT NULL)"""


def _specs(spark, sf_dir):
    """One campaign spec as text per segment, from the runs it lists."""
    c = standin.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("campaign"),
        (100 * (F.col("c_nationkey") % 7 + 1)).cast("string").alias("n"),
        (F.col("c_custkey") % 3 + 42).cast("string").alias("seed"),
    )
    return c.groupBy("campaign").agg(
        F.concat(F.array_join(F.collect_set("n"), ", "), F.lit(", ,full")).alias("points"),
        F.array_join(F.collect_set("seed"), " ,").alias("seeds"),
        F.lit("1,2, 3,4+").alias("buckets"),
    )


def _finished_keys(spark, sf_dir):
    done = r.density_runs(_runs(spark, sf_dir))
    key = F.concat(
        F.lit("n"), "num_train_images", F.lit("_density"), "density_bucket", F.lit("_seed"), "seed"
    )
    return done.select("campaign", key.alias("run"))


@query(f"""WITH {_GRID}
SELECT campaign, run, CAST(nullif(point, 'full') AS INTEGER) AS point, seed,
  CAST(replace(label, '+', '') AS INTEGER) AS lo,
  CASE WHEN label <> '4+' THEN CAST(label AS INTEGER) END AS hi
FROM grid ANTI JOIN done USING (campaign, run)""")
def run_grid_pending(spark, sf_dir):
    grid = r.run_grid(_specs(spark, sf_dir), density=True)
    pending = r.pending_runs(grid, _finished_keys(spark, sf_dir), on=["campaign", "run"])
    return pending.select("campaign", "run", "point", "seed", "lo", "hi")


@query(f"""WITH {_GRID}
SELECT campaign, CASE WHEN d.run IS NULL THEN 'planned' ELSE 'skipped' END AS status, count(*) AS n
FROM grid g LEFT JOIN done d USING (campaign, run) GROUP BY 1, 2""")
def run_grid_status(spark, sf_dir):
    grid = r.run_grid(_specs(spark, sf_dir), density=True)
    status = r.grid_status(grid, _finished_keys(spark, sf_dir), on=["campaign", "run"])
    return status.groupBy("campaign", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RUNS}
SELECT campaign, run, CASE WHEN s >= 86400 THEN (s // 86400) || ' j ' ELSE '' END
  || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ' h '
  || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ' min' AS text
FROM (SELECT campaign, run, CAST(elapsed_seconds * 40 AS BIGINT) AS s FROM runs WHERE finished)""")
def duration_texts(spark, sf_dir):
    from annotary.functions.naming import duration_text

    return _summaries(spark, sf_dir).select(
        "campaign", "run", duration_text(F.col("elapsed_seconds") * 40).alias("text")
    )


# -- events ------------------------------------------------------------------------

_EVENTS = """log AS (
  SELECT 'user-' || user_id AS run, CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'val'
    ELSE event_type END AS type, event_id AS iteration, value AS loss FROM events),
last AS (SELECT run, type, max(iteration) AS iteration, arg_max(loss, iteration) AS loss FROM log GROUP BY 1, 2)"""


def _events(spark, sf_dir):
    kind = F.col("event_type")
    return standin.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("run"),
        F.when(kind == "click", "train").when(kind == "view", "val").otherwise(kind).alias("type"),
        F.col("event_id").alias("iteration"),
        F.col("value").alias("loss"),
    )


@query(f"WITH {_EVENTS} SELECT run, type, iteration, loss FROM last")
def last_event(spark, sf_dir):
    return r.last_events(_events(spark, sf_dir))


_PROGRESS = f"""{_EVENTS},
progress AS (SELECT run, iteration, loss, 200000 AS iterations,
  100.0::DOUBLE * iteration / 200000 AS percent,
  CASE WHEN iteration = 0 THEN 0 ELSE n * 30.0::DOUBLE / iteration END AS rate,
  (200000 - iteration) * CASE WHEN iteration = 0 THEN 0 ELSE n * 30.0::DOUBLE / iteration END AS seconds_left
  FROM last JOIN (SELECT run, count(*) AS n FROM log GROUP BY 1) USING (run) WHERE type = 'train')"""


def _progress(spark, sf_dir):
    events = _events(spark, sf_dir)
    targets = events.groupBy("run").agg(
        (F.count(F.lit(1)) * 30.0).alias("elapsed_seconds"), F.lit(200_000).alias("iterations")
    )
    return r.run_progress(r.last_events(events), targets)


@query(f"""WITH {_PROGRESS}
SELECT run, iteration, loss, iterations, round(percent, 6) AS percent,
  round(rate, 6) AS seconds_per_iteration, round(seconds_left, 4) AS seconds_left FROM progress""")
def run_progress(spark, sf_dir):
    p = _progress(spark, sf_dir)
    return p.withColumn("seconds_left", F.round("seconds_left", 4)).withColumn(
        "percent", F.round("percent", 6)
    ).withColumn("seconds_per_iteration", F.round("seconds_per_iteration", 6))


@query(f"""WITH {_RUNS}, {_PROGRESS},
done AS (SELECT count(*) AS n_done, avg(elapsed_seconds) AS m FROM runs WHERE finished),
going AS (SELECT count(*) AS n_running, sum(seconds_left) AS s FROM progress),
eta AS (SELECT *, greatest(0, (SELECT count(*) FROM runs) * 2 - n_done - n_running) AS n_queued FROM done, going)
SELECT n_done, n_running, n_queued, round(m, 4) AS mean_run_seconds,
  round(s, 2) AS running_seconds_left, round(s + n_queued * m, 2) AS seconds_left FROM eta""")
def campaign_eta(spark, sf_dir):
    expected = standin.table(spark, sf_dir, "customer").count() * 2
    eta = r.campaign_eta(_summaries(spark, sf_dir), _progress(spark, sf_dir), expected)
    return eta.select(
        "n_done", "n_running", "n_queued", F.round("mean_run_seconds", 4).alias("mean_run_seconds"),
        F.round("running_seconds_left", 2).alias("running_seconds_left"),
        F.round("seconds_left", 2).alias("seconds_left"),
    )


@query(f"""WITH {_EVENTS}
SELECT type, count(*) AS n, max(iteration) AS iteration, round(sum(loss), 4) AS loss FROM log GROUP BY 1""")
def event_log_scan(spark, sf_dir):
    """Events written as JSON lines and scanned with the log's own schema."""
    path = scratch_path(spark, "events")
    _events(spark, sf_dir).drop("run").write.json(path)
    return run_events(spark, path).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("iteration").alias("iteration"),
        F.round(F.sum("loss"), 4).alias("loss"),
    )


# -- streams -----------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT run, type, iteration, loss FROM last")
def stream_progress(spark, sf_dir):
    """Last event per run and kind over landed event files."""
    path = scratch_path(spark, "landed")
    _events(spark, sf_dir).repartition(4).write.json(path)
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("run", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("iteration", T.LongType()),
            T.StructField("loss", T.DoubleType()),
        ]
    )
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(path)
    return drain_update(live_progress.live_last_events(stream), "progress", ["run", "type"])


@query("""WITH flagged AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM flagged),
grouped AS (SELECT user_id, k, arg_min(event_id, (ts, event_id)) AS session_id, count(*) AS n_events FROM numbered GROUP BY 1, 2)
SELECT user_id, session_id, n_events FROM grouped""")
def stream_sessions(spark, sf_dir):
    """Sessions per user on a live stream of several files, each in no order.

    A last row far ahead in time ends the stream, so that the watermark closes
    the sessions still open; it is no event itself.
    """
    stored = standin.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "landed")
    parts = F.ntile(3).over(Window.orderBy("day"))  # one row a day
    days = stored.select(F.to_date("ts").alias("day")).distinct().withColumn("part", parts)
    placed = stored.withColumn("day", F.to_date("ts")).join(days, "day").drop("day")
    for part in (1, 2, 3):
        placed.filter(F.col("part") == part).drop("part").repartition(2, "event_id").write.mode("append").parquet(path)
    end = stored.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    end.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "ts").write.mode("append").parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 2).parquet(path)
    closed = live_sessions.live_sessions(stream, ["user_id"], "event_id", "ts", "10 minutes", 3600)
    return drain_append(closed, "sessions").filter("user_id >= 0").select("user_id", "session_id", "n_events")
