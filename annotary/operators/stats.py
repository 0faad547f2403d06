"""Per-image and per-source statistics, pivots and histograms."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.operators.intervals import interval_lookup
from annotary.session import join_null_safe

CLASS_SEPARATOR = "|"
SPLITS = ["train", "val", "test"]
# The columns of the statistics table, in order.
STATS_COLUMNS = [
    "image_id",
    "source",
    "width",
    "height",
    "megapixels",
    "n_instances",
    "instances_per_megapixel",
    "classes",
]


def _with_sizes(df: DataFrame) -> DataFrame:
    mpx = F.col("width").cast("double") * F.col("height") / F.lit(1e6)
    return df.withColumn("megapixels", mpx).withColumn(
        "instances_per_megapixel",
        F.when(F.col("megapixels") == 0, F.lit(0.0)).otherwise(
            F.col("n_instances") / F.col("megapixels")
        ),
    )


def image_stats(records: DataFrame) -> DataFrame:
    """Nested records to one stats row each; no shuffle."""
    classes = F.array_sort(F.array_distinct(F.transform("instances", lambda i: i["source_class"])))
    return _with_sizes(
        records.withColumn("n_instances", F.size("instances").cast("long")).withColumn(
            "classes", F.array_join(classes, CLASS_SEPARATOR)
        )
    ).select(*STATS_COLUMNS, *(["split"] if "split" in records.columns else []))


def image_stats_flat(images: DataFrame, instances: DataFrame) -> DataFrame:
    """The same from two flat tables. Per image only the set of its classes
    travels, bounded by the class vocabulary, whatever the instance count."""
    per_image = instances.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_instances"),
        F.array_join(F.array_sort(F.collect_set("source_class")), CLASS_SEPARATOR).alias("classes"),
    )
    joined = images.drop("n_instances", "classes").join(per_image, "image_id", "left").withColumn(
        "n_instances", F.coalesce("n_instances", F.lit(0))
    ).withColumn("classes", F.coalesce("classes", F.lit("")))
    return _with_sizes(joined).select(
        *STATS_COLUMNS, *(["split"] if "split" in images.columns else [])
    )


def source_stats(stats: DataFrame) -> DataFrame:
    """Per source: images, instances, density, mean size, distinct classes.

    Classes are counted as distinct (source, class) pairs; no set is collected.
    """
    totals = stats.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum("n_instances").alias("n_instances"),
        F.avg("n_instances").alias("density"),
        F.avg("megapixels").alias("mean_megapixels"),
    )
    names = stats.select("source", F.explode(F.split("classes", r"\|")).alias("_class"))
    counts = names.filter(F.col("_class") != "").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_classes"))
    return join_null_safe(totals, counts, ["source"], "left").withColumn("n_classes", F.coalesce("n_classes", F.lit(0)))


def class_source_pivot(instances: DataFrame, sources, class_col="canonical") -> DataFrame:
    """Class x source counts with zeros and a total, one shuffle."""
    counts = [
        F.count(F.when(F.col("source") == source, 1)).alias(source) for source in sources
    ]
    return instances.groupBy(class_col).agg(
        *counts, F.count(F.when(F.col("source").isin(list(sources)), 1)).alias("total")
    )


def split_source_counts(images: DataFrame, splits=SPLITS) -> DataFrame:
    return images.groupBy("source").agg(
        *[F.count(F.when(F.col("split") == name, 1)).alias(name) for name in splits]
    )


def density_histogram(images: DataFrame, clip=12) -> DataFrame:
    """Share of images per instance count (the tail in one bin) and the mean."""
    per_bin = (
        images.withColumn("bin", F.least("n_instances", F.lit(clip)))
        .groupBy("source", "bin")
        .agg(F.count(F.lit(1)).alias("n_images"), F.sum("n_instances").alias("_sum"))
    )
    whole = Window.partitionBy("source")  # at most clip + 1 rows each
    return per_bin.select(
        "source",
        "bin",
        "n_images",
        (F.col("n_images") / F.sum("n_images").over(whole)).alias("share"),
        (F.sum("_sum").over(whole) / F.sum("n_images").over(whole)).alias("mean_instances"),
    )


def log_histogram(df: DataFrame, value, source="source", n_edges=40, floor=0.01) -> DataFrame:
    """Share of rows per geometric bin, with each source's mean, min and max.

    Edges run from 0.95 x the (floored) minimum to 1.05 x the maximum of all
    rows, so no row sits on an outer edge.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low, high = floor, floor
    start, stop = math.log(max(low, floor) * 0.95), math.log(high * 1.05)
    n_bins = n_edges - 1
    x = F.col(value).cast("double")
    position = (F.ln(F.when(x > 0, x)) - F.lit(start)) / F.lit(stop - start) * n_bins
    per_bin = (
        df.select(F.col(source).alias("source"), x.alias("_x"), F.floor(position).alias("bin"))
        .groupBy("source", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_x").alias("_sum"),
            F.min("_x").alias("_min"),
            F.max("_x").alias("_max"),
        )
    )
    whole = Window.partitionBy("source")  # at most n_bins + 2 rows each
    return per_bin.select(
        "source",
        "bin",
        "n",
        (F.col("n") / F.sum("n").over(whole)).alias("share"),
        (F.sum("_sum").over(whole) / F.sum("n").over(whole)).alias("mean"),
        F.min("_min").over(whole).alias("min"),
        F.max("_max").over(whole).alias("max"),
    ).filter((F.col("bin") >= 0) & (F.col("bin") < n_bins))


# The instance-count strata of the density axis.
DENSITY_STRATA = [("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4+", 4, None)]


def strata_sizes(images: DataFrame, buckets: DataFrame, by=("source",)) -> DataFrame:
    """Images per density stratum; ``buckets`` is ``(label, lo, hi)``.

    The strata must not overlap; there may be any number of them. Counts are
    aggregated per exact instance count first, so the lookup runs on the few
    distinct counts and not on images.
    """
    per_count = images.groupBy(*by, "n_instances").agg(F.count(F.lit(1)).alias("n"))
    return (
        interval_lookup(per_count, "n_instances", buckets)
        .groupBy(*by, "label")
        .agg(F.sum("n").alias("n_images"))
    )


# Control totals of the three public corpora.
CONTROL_TOTALS = [
    ("vehide", 13945, 36081),
    ("cardd", 4000, 8740),
    ("hitl", 814, 9084),
]


def control_totals(spark) -> DataFrame:
    return spark.createDataFrame(
        CONTROL_TOTALS, "source string, expected_images long, expected_instances long"
    )


def reconcile(actual: DataFrame, drops: DataFrame, controls: DataFrame) -> DataFrame:
    """Actual against expected totals, each gap explained as far as it goes.

    ``actual``: source, n_images, n_instances. ``drops``: source,
    dropped_instances, corrupted_images, corrupted_instances. All three have
    one row per source.
    """

    def status(gap, unexplained):
        return (
            F.when(gap == 0, "exact")
            .when(unexplained == 0, "explained")
            .otherwise("unexplained")
        )

    zero = F.lit(0)
    joined = (
        controls.join(actual, "source", "left")
        .join(drops, "source", "left")
        .select(
            "source",
            F.coalesce("n_images", zero).alias("n_images"),
            "expected_images",
            F.coalesce("corrupted_images", zero).alias("corrupted_images"),
            F.coalesce("n_instances", zero).alias("n_instances"),
            "expected_instances",
            F.coalesce("dropped_instances", zero).alias("dropped_instances"),
            F.coalesce("corrupted_instances", zero).alias("corrupted_instances"),
        )
    )
    image_gap = F.col("expected_images") - F.col("n_images")
    instance_gap = F.col("expected_instances") - F.col("n_instances")
    image_rest = image_gap - F.col("corrupted_images")
    instance_rest = instance_gap - F.col("dropped_instances") - F.col("corrupted_instances")
    return (
        joined.withColumn("image_gap", image_gap)
        .withColumn("image_unexplained", F.when(image_gap == 0, zero).otherwise(image_rest))
        .withColumn("image_status", status(image_gap, image_rest))
        .withColumn("instance_gap", instance_gap)
        .withColumn(
            "instance_unexplained", F.when(instance_gap == 0, zero).otherwise(instance_rest)
        )
        .withColumn("instance_status", status(instance_gap, instance_rest))
    )
