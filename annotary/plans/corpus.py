"""From annotation folders to a split, harmonised, reported corpus."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.operators import coco, split, stats, taxonomy
from annotary.operators.records import flatten_records
from annotary.session import pinned
from annotary.sources import sinks
from annotary.sources.images import corruption_counters, scan_images, split_readable
from annotary.sources.registry import LOADERS

# Split seed, and the corpora whose official splits are kept.
SPLIT_SEED = 42
KEEP_OFFICIAL = ["cardd"]


def load_corpora(spark: SparkSession, datasets_root, sources=None):
    """``(records, drops)`` of all corpora, unreadable images removed.

    ``drops`` has one row per source with everything that was left out.
    """
    records = None
    for source in sources or list(LOADERS):
        loader, folder = LOADERS[source]
        part = loader(spark, f"{datasets_root.rstrip('/')}/{folder}")
        records = part if records is None else records.unionByName(part)
    records = pinned(records)
    roots = [f"{datasets_root.rstrip('/')}/{LOADERS[s][1]}" for s in sources or list(LOADERS)]
    scan = scan_images(spark, roots)
    kept, dropped = split_readable(records, scan)
    kept = pinned(kept)
    loaded = records.groupBy("source").agg(
        F.sum("n_degenerate").cast("long").alias("degenerate_polygons"),
        F.sum("n_dropped").cast("long").alias("dropped_instances"),
        F.sum("n_holes").cast("long").alias("interior_holes_dropped"),
    )
    drops = loaded.join(corruption_counters(dropped), "source", "left").na.fill(
        0, ["corrupted_images", "corrupted_instances"]
    )
    return kept, pinned(drops)


def split_corpora(records: DataFrame, seed=SPLIT_SEED, keep_official=KEEP_OFFICIAL) -> DataFrame:
    """Split every corpus on its own, in one job, and check the union."""
    done = split.group_split(
        records, seed=seed, keep_official=keep_official,
        n_instances=F.size("instances"), corpus="source",
    )
    done = pinned(done)
    split.require_no_leak(done)
    return done


def build_corpus(spark: SparkSession, datasets_root, out, canonical=None, mappings=None, sources=None):
    """The whole build. Writes under ``out``: ``stats``, ``<source>/`` triples
    and documents; returns the report text."""
    if mappings is None:
        canonical, mappings = taxonomy.damage_taxonomy(spark)
    taxonomy.require_valid_taxonomy(canonical, mappings)
    sources = list(sources or LOADERS)
    started = time.perf_counter()
    records, drops = load_corpora(spark, datasets_root, sources)
    records = split_corpora(records)
    load_seconds = time.perf_counter() - started

    images, instances = flatten_records(records)
    harmonised = pinned(taxonomy.harmonise(instances, mappings))
    per_image = stats.image_stats(records)
    sinks.write_stats(per_image, f"{out}/stats")

    started = time.perf_counter()
    for source in sources:
        triple = coco.coco_triple(
            images.filter(F.col("source") == source), harmonised.filter(F.col("source") == source)
        )
        sinks.write_triple(*triple, f"{out}/{source}")
    export_seconds = time.perf_counter() - started

    per_source = stats.source_stats(per_image)
    gaps = stats.reconcile(
        per_source, drops, stats.control_totals(spark).filter(F.col("source").isin(sources))
    )
    sections = [
        ("Totals against controls", gaps.orderBy("source")),
        ("Dropped on reading", drops.orderBy("source")),
        ("Densities per corpus", per_source.orderBy("source")),
        (
            "Instances per canonical class",
            stats.class_source_pivot(harmonised, sources).orderBy("canonical"),
        ),
        ("Leak-free splits", stats.split_source_counts(records).orderBy("source")),
    ]
    lines = ["# Corpus report", "", f"Split seed {SPLIT_SEED}.", ""]
    for title, frame in sections:
        lines += [f"## {title}", "", sinks.markdown_table(frame), ""]
    lines += [
        "## Run time", "",
        f"Loading and splitting {load_seconds:.1f} s, export {export_seconds:.1f} s.", "",
    ]
    return "\n".join(lines)
