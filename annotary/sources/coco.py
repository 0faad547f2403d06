"""COCO annotations: raw documents in, harmonised triples back in."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary import schemas
from annotary.checks import CorpusError, require_empty
from annotary.functions.naming import image_key
from annotary.operators.records import clean_instances, nest_records
from annotary.session import sized
from annotary.sources.document import document_sections
from annotary.sources.images import list_files, require_files

# Corpus name and official splits.
SOURCE = "cardd"
SPLITS = ["train", "val", "test"]


def coco_documents(spark: SparkSession, path, lines=False, split=False) -> DataFrame:
    """One row per document; ``lines`` reads one (partial) document per line.

    ``split`` reads one large document by many tasks and gives a partial
    document for each of its elements.
    """
    if split:
        elements = document_sections(spark, path)
        parts = []
        for field in schemas.COCO_DOCUMENT:
            one = F.from_json("element", field.dataType.elementType)
            parts.append(F.when(F.col("section") == field.name, F.array(one)).alias(field.name))
        return elements.select(*parts)
    return spark.read.schema(schemas.COCO_DOCUMENT).json(path, multiLine=not lines)


def named_annotations(documents: DataFrame):
    """``(annotations, categories)`` as they are, each annotation with its class name, if it has one.

    Categories are few; as a table of known size they go to the annotations, which stay where they are.
    """
    raw = documents.select(F.explode("annotations").alias("a")).select("a.*")
    categories = sized(documents.select(F.explode("categories").alias("c")).select("c.*").distinct())
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("source_class"))
    return raw.join(names, "category_id", "left"), categories


def rejected(named: DataFrame) -> DataFrame:
    """Run-length and crowd annotations, and those of a category nobody declared."""
    odd = (
        (F.coalesce("iscrowd", F.lit(0)) != 0)
        | ~F.coalesce(F.ltrim("segmentation").startswith("["), F.lit(False))
        | F.col("source_class").isNull()
    )
    return named.filter(odd).select("id", "image_id", "category_id", "iscrowd")


def coco_tables(documents: DataFrame):
    """``(images, annotations, categories)`` with polygons parsed.

    Run-length or crowd annotations, and categories nobody declared, stop the
    job: they mean a corpus of another kind.
    """
    images = documents.select(F.explode("images").alias("i")).select("i.*")
    named, categories = named_annotations(documents)
    require_empty(
        rejected(named),
        "run-length, crowd or uncategorised annotation",
        CorpusError,
    )
    annotations = named.withColumn("polygon", F.from_json("segmentation", schemas.RINGS)).drop(
        "segmentation", "iscrowd"
    )
    return images, annotations, categories


def coco_flat(documents: DataFrame, split, image_dir, source=SOURCE):
    """Flat ``(images, cleaned instances)`` of one split; ``pos`` is the
    annotation id. Cleaning counts what it drops, see ``kept_instances``."""
    images, annotations, _ = coco_tables(documents)
    key = image_key(F.lit(source), "file_name")
    shaped = images.select(
        key.alias("image_id"),
        F.concat(F.lit(image_dir.rstrip("/") + "/"), F.col("file_name")).alias("file_path"),
        "width",
        "height",
        F.lit(source).alias("source"),
        F.lit(split).alias("split_hint"),
        key.alias("group_id"),
        F.col("id").alias("_local"),
    )
    cleaned = clean_instances(
        annotations.select(
            F.col("image_id").alias("_local"), F.col("id").alias("pos"), "source_class", "polygon"
        )
    )
    instances = cleaned.join(shaped.select("_local", "image_id", "source"), "_local").drop("_local")
    return shaped.drop("_local"), instances


def coco_records(spark: SparkSession, root, lines=False, check_files=True) -> DataFrame:
    """The three official splits as records; unannotated images stay."""
    root = root.rstrip("/")
    out = None
    for split in SPLITS:
        images, instances = coco_flat(
            coco_documents(spark, f"{root}/{split}.json", lines), split, f"{root}/{split}"
        )
        counters = instances.groupBy("image_id").agg(
            F.sum("n_degenerate").cast("int").alias("n_degenerate"),
            F.sum(F.col("dropped").cast("int")).cast("int").alias("n_dropped"),
        )
        records = nest_records(images, instances.filter(~F.col("dropped"))).join(
            counters, "image_id", "left"
        )
        out = records if out is None else out.unionByName(records)
    out = out.select(
        *schemas.RECORD_COLUMNS,
        F.coalesce("n_degenerate", F.lit(0)).alias("n_degenerate"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.lit(0).alias("n_holes"),
    )
    if check_files:
        require_files(out, list_files(spark, [f"{root}/{split}" for split in SPLITS]))
    return out


def read_triple(spark: SparkSession, path):
    """A harmonised export, see ``sinks.write_triple``."""
    return tuple(
        spark.read.parquet(f"{path}/{name}") for name in ("images", "annotations", "categories")
    )


def class_counts(annotations: DataFrame, categories: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations per class name and source of a harmonised export."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("class"))
    return (
        annotations.select("image_id", "category_id")
        .join(images.select(F.col("id").alias("image_id"), "source"), "image_id")
        .join(names, "category_id")
        .groupBy("class", "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )
