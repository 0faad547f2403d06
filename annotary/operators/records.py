"""Images and instances: nested records and their flat two-table form.

The flat form (``images``, ``instances`` with ``image_id`` and ``pos``) is the
one to compute on at scale: it aggregates partially and never needs all
instances of an image in one place. The nested form is what the annotation
formats deliver and what a record consumer wants.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.functions import geometry as g
from annotary.functions.measures import polygon_measures
from annotary.session import evaluate_once


def instance_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_instances"))


def with_instance_counts(images: DataFrame, instances: DataFrame) -> DataFrame:
    """Left outer: unannotated images stay, with 0."""
    return images.join(instance_counts(instances), "image_id", "left").withColumn(
        "n_instances", F.coalesce("n_instances", F.lit(0))
    )


def flatten_records(records: DataFrame):
    """Nested records to ``(images, instances)``; ``pos`` keeps the order."""
    images = records.withColumn("n_instances", F.size("instances").cast("long")).drop("instances")
    instances = records.select(
        "image_id", "source", F.posexplode("instances").alias("pos", "inst")
    ).select("image_id", "source", "pos", "inst.*")
    return images, instances


def nest_records(images: DataFrame, instances: DataFrame) -> DataFrame:
    """``instances`` collected into their image in ``pos`` order.

    A record is one row by definition, so this is for images whose instances
    fit in one; statistics and exports work on the flat form instead.
    """
    nested = instances.groupBy("image_id").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "source_class", "polygon", "bbox", "area"))
        ).alias("_items")
    )
    return (
        images.join(nested, "image_id", "left")
        .withColumn(
            "instances",
            F.transform(
                F.coalesce("_items", F.expr("array()")),
                lambda i: F.struct(
                    i["source_class"].alias("source_class"),
                    i["polygon"].alias("polygon"),
                    i["bbox"].alias("bbox"),
                    i["area"].alias("area"),
                ),
            ),
        )
        .drop("_items")
    )


def clean_instances(instances: DataFrame) -> DataFrame:
    """Ring-by-ring cleaning with the counters that make it accountable.

    ``n_degenerate`` counts dropped rings, ``dropped`` marks instances of
    which none is left, ``extent`` keeps the coordinate ranges of the rest.
    Nothing is removed here; see ``kept_instances``. Every ring is measured
    once, in place.
    """
    read = evaluate_once(instances, _m=polygon_measures("polygon"))
    rings, n_rings = F.coalesce("polygon", F.expr("array()")), F.coalesce(F.size("polygon"), F.lit(0))
    good = F.filter(rings, lambda _, i: F.get(F.col("_m.good"), i))
    return (
        read.withColumn("n_degenerate", n_rings - F.col("_m.n_good"))
        .withColumn("polygon", F.when(F.col("_m.n_good") == F.size("polygon"), F.col("polygon")).otherwise(good))
        .withColumn("extent", F.col("_m.extent"))
        .withColumn("dropped", F.col("_m.n_good") == 0)
        .withColumn("area", F.col("_m.area"))
        .withColumn("bbox", g.extent_bbox("extent"))
        .drop("_m")
    )


def mark_out_of_frame(cleaned: DataFrame) -> DataFrame:
    """Mark instances wholly outside their frame; needs ``width``, ``height``."""
    outside = g.extent_out_of_frame("extent", "width", "height")
    return cleaned.withColumn("dropped", F.col("dropped") | outside)


def kept_instances(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(~F.col("dropped")).drop("dropped", "n_degenerate", "extent")


def drop_counters(cleaned: DataFrame, by="source", holes=None) -> DataFrame:
    """Per source: dropped rings, dropped instances, interior holes left out."""
    return cleaned.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_read"),
        F.sum("n_degenerate").cast("long").alias("degenerate_polygons"),
        F.sum(F.col("dropped").cast("long")).alias("dropped_instances"),
        F.sum(F.col(holes) if holes else F.lit(0)).cast("long").alias("interior_holes_dropped"),
    )


def select_split(images: DataFrame, split: str) -> DataFrame:
    """Images of one split; an empty answer is an error naming the others."""
    chosen = images.filter(F.col("split") == split)
    if not chosen.take(1):
        known = [r[0] for r in images.select("split").distinct().orderBy("split").collect()]
        raise ValueError(f"no image with split {split!r}; available: {known}")
    return chosen


def resolve_paths(images: DataFrame, root=None, path="source_file_path") -> DataFrame:
    """Explicit path first, else ``root/file_name``, else an error."""
    given = F.when(F.col(path) != "", F.col(path))
    if root is not None:
        resolved = F.coalesce(given, F.concat_ws("/", F.lit(root.rstrip("/")), F.col("file_name")))
    else:
        resolved = F.coalesce(
            given,
            F.raise_error(F.concat(F.lit("no path and no images root for "), F.col("file_name"))).cast(
                "string"
            ),
        )
    return images.withColumn("resolved_path", resolved)
