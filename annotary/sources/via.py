"""VIA annotations: a JSON map ``file name -> {name, regions}``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary import schemas
from annotary.checks import CorpusError, require_empty
from annotary.functions import geometry as g
from annotary.functions.measures import interleaved, ring_measures
from annotary.functions.naming import image_key, timestamp_group
from annotary.operators.sessions import link_thumbnails, merge_session_groups
from annotary.session import evaluate_once
from annotary.sources.document import document_entries
from annotary.sources.images import scan_images

# Where the corpus keeps its two official splits.
SOURCE = "vehide"
LAYOUT = [
    ("train", "0Train_via_annos.json", "image/image"),
    ("val", "0Val_via_annos.json", "validation/validation"),
]


def via_entries(spark: SparkSession, path, lines=False, split=False) -> DataFrame:
    """``(place, file_name, regions)``: map keys become rows.

    One document per file, or with ``lines`` one map per line. ``split`` reads
    one large document by many tasks.
    """
    if split:
        return document_entries(spark, path).select(
            "place", F.explode(F.from_json("entry", schemas.VIA_FILE)).alias("file_name", "entry")
        ).select("place", "file_name", F.col("entry.regions").alias("regions"))
    text = spark.read.text(path, wholetext=not lines)
    return text.select(
        F.posexplode(F.from_json("value", schemas.VIA_FILE)).alias("place", "file_name", "entry")
    ).select("place", "file_name", F.col("entry.regions").alias("regions"))


def via_instances(entries: DataFrame) -> DataFrame:
    """Add cleaned nested ``instances`` and the drop counters to entries.

    Needs ``regions``, ``width`` and ``height``; no shuffle. A region is
    dropped when degenerate or wholly outside a frame of known size.
    """
    regions = F.coalesce("regions", F.expr("array()"))
    read = evaluate_once(entries, _ring=interleaved(regions["all_x"], regions["all_y"]))
    read = evaluate_once(read, _measured=ring_measures("_ring"))
    rings = F.arrays_zip(regions["class"].alias("source_class"), F.col("_ring").alias("ring"), F.col("_measured").alias("m"))
    good = F.filter(
        "_rings",
        lambda r: (F.size(r["ring"]) >= 6)
        & (r["m"]["area"] > 0)
        & ~g.extent_out_of_frame(r["m"]["extent"], "width", "height"),
    )
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
        .withColumn("n_holes", F.lit(0))
        .drop("_ring", "_measured", "_rings", "_good", "regions")
    )


def via_records(spark: SparkSession, root, lines=False) -> DataFrame:
    """The whole corpus as records, sessions merged, thumbnails linked."""
    root = root.rstrip("/")
    entries = None
    for rank, (split, file_name, image_dir) in enumerate(LAYOUT):
        part = via_entries(spark, f"{root}/{file_name}", lines).select(
            "*",
            F.concat(F.lit(f"{root}/{image_dir}/"), F.col("file_name")).alias("file_path"),
            F.lit(split).alias("split_hint"),
            F.lit(rank).alias("_split_rank"),
        )
        entries = part if entries is None else entries.unionByName(part)
    sizes = scan_images(spark, [f"{root}/{d}" for _, _, d in LAYOUT]).select(
        F.col("path").alias("file_path"), "width", "height"
    )
    sized = entries.join(sizes, "file_path", "left")
    require_empty(
        sized.filter(F.col("width").isNull()).select("file_path"), "image missing or without size", CorpusError
    )
    loaded = via_instances(sized).select(
        image_key(F.lit(SOURCE), "file_name").alias("image_id"),
        "file_path",
        "width",
        "height",
        F.lit(SOURCE).alias("source"),
        "split_hint",
        timestamp_group("file_name").alias("group_id"),
        "instances",
        "n_degenerate",
        "n_dropped",
        "n_holes",
        F.struct("_split_rank", "place").alias("_order"),
    )
    linked = link_thumbnails(merge_session_groups(loaded), load_order="_order").drop("_order")
    # Prefixed last: the time stamps above are parsed from the bare form.
    return linked.withColumn("group_id", F.concat(F.lit(f"{SOURCE}/"), F.col("group_id")))
