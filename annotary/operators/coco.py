"""COCO triple (images, annotations, categories) with dense ordered ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.checks import CorpusError, require_empty
from annotary.functions.naming import basename
from annotary.operators.ordered import running_totals
from annotary.session import sized

SUPERCATEGORY = "damage"


def duplicate_ids(images: DataFrame, key="image_id") -> DataFrame:
    return images.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def category_table(instances: DataFrame, name="canonical") -> DataFrame:
    """Categories that occur, by name, numbered from 1."""
    names = instances.select(F.col(name).alias("name")).distinct()
    return running_totals(names, [F.col("name")], position="id").select(
        F.col("id").cast("int").alias("id"), "name", F.lit(SUPERCATEGORY).alias("supercategory")
    )


def image_ids(images: DataFrame) -> DataFrame:
    """``(image_id, id)`` in image order; only the key column is sorted."""
    return running_totals(images.select("image_id"), [F.col("image_id")], position="id")


def image_table(images: DataFrame, ids: DataFrame, origin_prefix="origin_") -> DataFrame:
    """COCO images; two extra columns under ``origin_prefix`` keep the corpus
    id and path, ``split`` is carried when there is one."""
    columns = [
        F.col("id"),
        basename("file_path").alias("file_name"),
        "width",
        "height",
        "source",
        F.col("image_id").alias(f"{origin_prefix}image_id"),
        "group_id",
        F.col("file_path").alias(f"{origin_prefix}file_path"),
    ]
    if "split" in images.columns:
        columns.append("split")
    return images.join(ids.select("image_id", "id"), "image_id").select(*columns)


def annotation_table(
    instances: DataFrame, images: DataFrame, categories: DataFrame, name="canonical"
) -> DataFrame:
    """COCO annotations numbered in image order, then instance order.

    ``pos`` orders the instances of an image; of ``images`` only the key is
    read. Image keys and instances are laid out together, once, in one global
    order: there the images before an instance give its image's number and the
    instances before it its own, so polygons move once and meet no wide join.
    An image with most of the annotations spreads over many tasks. Instances
    of unknown images are left out.
    """
    cats = sized(categories.select(F.col("id").alias("category_id"), F.col("name").alias(name)))
    unknown = sized(instances.select("image_id").distinct().join(images.select("image_id"), "image_id", "left_anti"))
    known = instances.filter(F.col("image_id").isNotNull()).join(unknown, "image_id", "left_anti")
    rows = known.join(cats, name).select("image_id", "pos", "category_id", "polygon", "bbox", "area", F.lit(1).alias("_kind"))
    heads = images.select("image_id", F.lit(0).alias("_kind"))
    laid = running_totals(
        heads.unionByName(rows, allowMissingColumns=True),
        [F.col("image_id"), F.col("_kind"), F.col("pos")],
        sums={"_image": 1 - F.col("_kind"), "_before": F.col("_kind")},
    )
    return laid.filter("_kind = 1").select(
        (F.col("_before") + 1).alias("id"),
        F.col("_image").alias("image_id"),
        "category_id",
        F.col("polygon").alias("segmentation"),
        "bbox",
        "area",
        F.lit(0).alias("iscrowd"),
    )


def coco_triple(images: DataFrame, instances: DataFrame, name="canonical", origin_prefix="origin_"):
    """``(images, annotations, categories)``, whatever the input order.

    ``instances`` are already harmonised: an excluded class has dropped its
    annotations, the image stays. A repeated ``image_id`` is an error.
    """
    require_empty(duplicate_ids(images), "duplicate image_id", CorpusError)
    ids = image_ids(images)
    categories = category_table(instances, name)
    return (
        image_table(images, ids, origin_prefix),
        annotation_table(instances, images, categories, name),
        categories,
    )
