"""Supervisely annotations: one JSON file per image."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary import schemas
from annotary.checks import CorpusError, require_empty
from annotary.functions import geometry as g
from annotary.functions.measures import ring_measures
from annotary.functions.naming import image_key
from annotary.session import evaluate_once
from annotary.sources.images import list_files, require_files

# Corpus name, the folder holding damages (the two folder names
# are swapped in this corpus) and the classes that prove it is the right one.
SOURCE = "hitl"
DATASET_DIR = "Car parts dataset"
CLASSES = [
    "Scratch",
    "Dent",
    "Broken part",
    "Paint chip",
    "Missing part",
    "Flaking",
    "Corrosion",
    "Cracked",
]


def class_set_difference(spark: SparkSession, meta_path, expected=CLASSES, lines=False) -> DataFrame:
    """Titles declared but not expected, or the reverse; empty when equal."""
    meta = spark.read.schema(schemas.SUPERVISELY_META).json(meta_path, multiLine=not lines)
    declared = meta.select(F.explode("classes.title").alias("title")).distinct()
    wanted = spark.createDataFrame([(c,) for c in expected], "title string")
    return declared.subtract(wanted).unionByName(wanted.subtract(declared))


def supervisely_objects(spark: SparkSession, path, lines=False) -> DataFrame:
    """``(file_name, width, height, objects)``; the image is named by its
    annotation file, or in the JSON-lines layout by the ``name`` field."""
    docs = spark.read.schema(schemas.SUPERVISELY_FILE).json(path, multiLine=not lines)
    if lines:
        name = F.col("name")
    else:
        name = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"\.json$", "")
    return docs.select(
        name.alias("file_name"),
        F.col("size.width").alias("width"),
        F.col("size.height").alias("height"),
        F.coalesce("objects", F.expr("array()")).alias("objects"),
    )


def supervisely_instances(docs: DataFrame, classes=CLASSES) -> DataFrame:
    """Nested ``instances`` and counters; only exterior rings are kept.

    Another geometry or class than expected stops the job.
    """
    odd = F.filter(
        "objects",
        lambda o: (o["geometryType"] != "polygon") | ~o["classTitle"].isin(list(classes)),
    )
    require_empty(
        docs.filter(F.size(odd) > 0).select(
            "file_name",
            F.transform(odd, lambda o: F.struct(o["id"], o["geometryType"], o["classTitle"])).alias("objects"),
        ),
        "unexpected geometry or class",
        CorpusError,
    )
    # flat lists of coordinates, all measured at once
    exteriors = F.transform(F.col("objects")["points"]["exterior"], lambda points: F.flatten(points))
    read = evaluate_once(docs, _ring=exteriors)
    read = evaluate_once(read, _measured=ring_measures("_ring"))
    holes = F.transform(
        F.col("objects")["points"]["interior"], lambda i: F.coalesce(F.size(F.coalesce(i, F.expr("array()"))), F.lit(0))
    )
    rings = F.arrays_zip(
        F.col("objects")["classTitle"].alias("source_class"),
        F.col("_ring").alias("ring"),
        F.col("_measured").alias("m"),
        holes.alias("holes"),
    )
    good = F.filter("_rings", lambda r: (F.size(r["ring"]) >= 6) & (r["m"]["area"] > 0))
    return (
        evaluate_once(read.withColumn("_rings", rings), _good=good)
        .withColumn(
            "instances",
            F.transform(
                "_good",
                lambda r: F.struct(
                    r["source_class"].alias("source_class"),
                    F.array(r["ring"]).alias("polygon"),
                    g.extent_bbox(r["m"]["extent"]).alias("bbox"),
                    r["m"]["area"].alias("area"),
                ),
            ),
        )
        .withColumn("n_degenerate", F.size("_rings") - F.size("_good"))
        .withColumn("n_dropped", F.col("n_degenerate"))
        .withColumn("n_holes", F.aggregate("_good", F.lit(0), lambda acc, r: acc + r["holes"]))
        .drop("_ring", "_measured", "_rings", "_good", "objects")
    )


def supervisely_records(spark: SparkSession, root, check_files=True) -> DataFrame:
    base = f"{root.rstrip('/')}/{DATASET_DIR}"
    require_empty(
        class_set_difference(spark, f"{base}/meta.json"),
        "meta.json does not declare the expected classes (swapped folders?)",
        CorpusError,
    )
    docs = supervisely_instances(supervisely_objects(spark, f"{base}/File1/ann"))
    key = image_key(F.lit(SOURCE), "file_name")
    records = docs.select(
        key.alias("image_id"),
        F.concat(F.lit(f"{base}/File1/img/"), F.col("file_name")).alias("file_path"),
        "width",
        "height",
        F.lit(SOURCE).alias("source"),
        F.lit(None).cast("string").alias("split_hint"),
        key.alias("group_id"),
        "instances",
        "n_degenerate",
        "n_dropped",
        "n_holes",
    )
    if check_files:
        require_files(records, list_files(spark, f"{base}/File1/img"))
    return records
