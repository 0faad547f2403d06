"""Experiment runs: seed aggregates, axis tables, pending work, progress."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.functions.naming import (
    bucket_array_label,
    bucket_label,
    duration_text,
    run_key,
)

# Category orders of the result tables.
DENSITY_ORDER = ["1", "2", "3", "4+"]
REFERENCE = "Référence (U-Net)"
NO_SKIPS = "U-Net sans skips"
COPY_PASTE = "Copy-Paste"
CONDITION_ORDER = [REFERENCE, NO_SKIPS, COPY_PASTE]


def join_runs(summaries: DataFrame, configs: DataFrame) -> DataFrame:
    """Finished runs only: a run counts when summary and config both exist."""
    config = configs.select(
        "campaign",
        "run",
        "seed",
        "model",
        F.coalesce("copy_paste", F.lit(False)).alias("copy_paste"),
        F.size("corpus").alias("n_corpus"),
        bucket_array_label("density_bucket").alias("density_bucket"),
    )
    return summaries.drop("seed").join(config, ["campaign", "run"])


def seed_aggregate(runs: DataFrame, by) -> DataFrame:
    """Mean, spread and cost over seeds; one seed has no standard deviation."""
    by = [by] if isinstance(by, str) else list(by)
    return runs.groupBy(*by).agg(
        F.countDistinct("seed").alias("n_seeds"),
        F.avg("best_val_iou").alias("iou_mean"),
        F.stddev_samp("best_val_iou").alias("iou_std"),
        F.min("best_val_iou").alias("iou_min"),
        F.max("best_val_iou").alias("iou_max"),
        (F.sum("elapsed_seconds") / 3600.0).alias("gpu_hours"),
    )


def most_frequent(df: DataFrame, col, by=()) -> DataFrame:
    """Most frequent value, the smallest among ties; counts merge map-side."""
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.struct(-F.col("n"), F.col(col))
    return counts.groupBy(*by).agg(F.min_by(col, ordered).alias(col), F.max("n").alias("n"))


def volume_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(
        F.col("density_bucket").isNull() & (F.col("model") == "unet") & ~F.col("copy_paste")
    )


def density_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("density_bucket").isNotNull())


def volume_table(runs: DataFrame) -> DataFrame:
    return seed_aggregate(volume_runs(runs), "num_train_images").orderBy("num_train_images")


def _ordinal(col, order):
    """Place of a value in a fixed order, null outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col))
    return F.when(place > 0, place)


def density_table(runs: DataFrame) -> DataFrame:
    """Seed aggregate per stratum in the fixed order; other labels come last."""
    return seed_aggregate(density_runs(runs), "density_bucket").orderBy(
        _ordinal("density_bucket", DENSITY_ORDER).asc_nulls_last(), "density_bucket"
    )


def with_condition(runs: DataFrame) -> DataFrame:
    return runs.withColumn(
        "condition",
        F.when(F.col("model") == "baseline", NO_SKIPS)
        .when(F.col("copy_paste"), COPY_PASTE)
        .otherwise(REFERENCE),
    )


def ablation_table(runs: DataFrame) -> DataFrame:
    """Conditions side by side, only at volumes where a variant was run."""
    labelled = with_condition(runs.filter(F.col("density_bucket").isNull()))
    anchors = labelled.filter(F.col("condition") != REFERENCE).select("num_train_images").distinct()
    anchored = labelled.join(anchors, "num_train_images", "left_semi")
    return (
        seed_aggregate(anchored, "condition")
        .filter(F.col("condition").isin(CONDITION_ORDER))
        .orderBy(_ordinal("condition", CONDITION_ORDER))
    )


def run_details(runs: DataFrame) -> DataFrame:
    return runs.orderBy("campaign", "num_train_images", "seed", "run")


def campaign_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("campaign").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.countDistinct("seed").alias("n_seeds"),
        (F.sum("elapsed_seconds") / 3600.0).alias("gpu_hours"),
        F.avg("elapsed_seconds").alias("mean_run_seconds"),
    )


def last_finished(runs: DataFrame, n=5) -> DataFrame:
    """The last ``n`` runs in directory-name order (a top-k report)."""
    return runs.orderBy(F.desc("campaign"), F.desc("run")).limit(n)


def last_events(events: DataFrame, run_keys=("run",)) -> DataFrame:
    """Newest event per run and kind; the maximum merges map-side.

    If a restarted run logged an iteration twice, the later line counts where
    events have a ``line``; else the largest of the other fields, in order (maps as text).
    """
    keys = [*run_keys, "type"]
    fields = [c for c in events.columns if c not in keys]
    first = [c for c in ("iteration", "line") if c in fields]
    rest = [c for c in fields if c not in first]
    order = [F.to_json(c) if isinstance(events.schema[c].dataType, T.MapType) else F.col(c) for c in rest]
    return (
        events.groupBy(*keys)
        .agg(F.max_by(F.struct(*fields), F.struct(*first, *order)).alias("_last"))
        .select(*keys, *[F.col("_last")[c].alias(c) for c in fields])
    )


def run_progress(last: DataFrame, targets: DataFrame, run_keys=("run",)) -> DataFrame:
    """Percent done, seconds per iteration and seconds left of running runs.

    ``targets``: run keys, ``iterations``, ``elapsed_seconds`` since the start.
    """
    train = last.filter(F.col("type") == "train").select(*run_keys, "iteration", "loss")
    rate = F.coalesce(F.try_divide("elapsed_seconds", "iteration"), F.lit(0.0))
    return (
        train.join(targets.select(*run_keys, "iterations", "elapsed_seconds"), list(run_keys))
        .withColumn("percent", 100.0 * F.col("iteration") / F.col("iterations"))
        .withColumn("seconds_per_iteration", rate)
        .withColumn("seconds_left", (F.col("iterations") - F.col("iteration")) * rate)
        .drop("elapsed_seconds")
    )


def campaign_eta(finished: DataFrame, progress: DataFrame, expected=None) -> DataFrame:
    """One row: counts, mean run time, seconds left and the readable duration."""
    done = finished.agg(
        F.count(F.lit(1)).alias("n_done"), F.avg("elapsed_seconds").alias("mean_run_seconds")
    )
    running = progress.agg(
        F.count(F.lit(1)).alias("n_running"),
        F.coalesce(F.sum("seconds_left"), F.lit(0.0)).alias("running_seconds_left"),
        F.max(F.col("iterations") * F.col("seconds_per_iteration")).alias("projected_run_seconds"),
    )
    both = done.withColumn("_one", F.lit(1)).join(
        F.broadcast(running.withColumn("_one", F.lit(1))), "_one"
    )
    total = F.lit(expected) if expected else F.col("n_done") + F.col("n_running")
    per_run = F.coalesce("mean_run_seconds", "projected_run_seconds", F.lit(0.0))
    return (
        both.withColumn(
            "n_queued", F.greatest(F.lit(0), total - F.col("n_done") - F.col("n_running"))
        )
        .withColumn(
            "seconds_left", F.col("running_seconds_left") + F.col("n_queued") * per_run
        )
        .withColumn("time_left", duration_text("seconds_left"))
        .drop("_one", "projected_run_seconds")
    )


def _tokens(specs: DataFrame, col, place) -> DataFrame:
    """Non-blank trimmed tokens of a comma-separated text, with their place."""
    return (
        specs.select("*", F.posexplode(F.split(F.col(col), ",")).alias(place, "_token"))
        .withColumn("_token", F.trim("_token"))
        .filter(F.col("_token") != "")
    )


def parse_points(specs: DataFrame, col="points") -> DataFrame:
    """``"50,100,full"`` to rows with ``point``; ``full`` is a null point."""
    token = F.when(F.lower("_token") != "full", F.col("_token"))
    return (
        _tokens(specs, col, "point_place")
        .withColumn("point", token.cast("int"))
        .drop("_token")
    )


def parse_seeds(specs: DataFrame, col="seeds") -> DataFrame:
    return (
        _tokens(specs, col, "seed_place")
        .withColumn("seed", F.col("_token").cast("int"))
        .drop("_token")
    )


def parse_buckets(specs: DataFrame, col="buckets") -> DataFrame:
    """``"1,2,4+"`` to ``lo``/``hi`` rows; a plus sign leaves ``hi`` open."""
    low = F.regexp_replace("_token", r"\+$", "").cast("int")
    return (
        _tokens(specs, col, "bucket_place")
        .withColumn("lo", low)
        .withColumn("hi", F.when(~F.col("_token").endswith("+"), low))
        .drop("_token")
    )


def run_grid(specs: DataFrame, density=False) -> DataFrame:
    """Every planned run of a campaign spec, with its run key.

    ``specs`` has one row per campaign: ``points`` and ``seeds`` as text, and
    ``buckets`` for the density axis. Unrolling the lists of one row gives the
    grid without any join.
    """
    grid = parse_seeds(parse_points(specs))
    if density:
        return parse_buckets(grid).withColumn("run", run_key("point", "seed", "lo", "hi"))
    return grid.withColumn("run", run_key("point", "seed"))


def pending_runs(grid: DataFrame, finished: DataFrame, force=False, on=("run",)) -> DataFrame:
    """Planned runs without a result yet; ``force`` plans them all again."""
    if force:
        return grid
    return grid.join(finished.select(*on).distinct(), list(on), "left_anti")


def grid_status(grid: DataFrame, finished: DataFrame, force=False, on=("run",)) -> DataFrame:
    """The whole grid with ``status`` skipped or planned."""
    done = finished.select(*on).distinct().withColumn("_done", F.lit(True))
    skip = F.coalesce("_done", F.lit(False)) & F.lit(not force)
    return (
        grid.join(done, list(on), "left")
        .withColumn("status", F.when(skip, "skipped").otherwise("planned"))
        .drop("_done")
    )


# Column order of the campaign result rows.
VOLUME_ROW = [
    "subset_n_images",
    "seed",
    "num_train_images",
    "best_val_iou",
    "best_iteration",
    "elapsed_seconds",
    "output_dir",
]
DENSITY_ROW = ["density_bucket", *VOLUME_ROW]


def result_rows(grid: DataFrame, summaries: DataFrame, output_root, density=False) -> DataFrame:
    """One row per finished cell of the grid, in the order it was planned."""
    places = ["bucket_place", "seed_place"] if density else ["point_place", "seed_place"]
    rows = (
        grid.join(summaries.drop("seed"), "run")
        .withColumn("subset_n_images", F.coalesce(F.col("point").cast("string"), F.lit("full")))
        .withColumn("output_dir", F.concat(F.lit(f"{str(output_root).rstrip('/')}/"), "run"))
        .orderBy(*places)
    )
    if density:
        return rows.withColumn("density_bucket", bucket_label("lo", "hi")).select(*DENSITY_ROW)
    return rows.select(*VOLUME_ROW)
