"""Loader per corpus name: ``(spark, root) -> records``."""

from annotary.sources import coco, supervisely, via

# Corpus order and folder names below the datasets root.
LOADERS = {
    via.SOURCE: (via.via_records, "vehide"),
    coco.SOURCE: (coco.coco_records, "cardd"),
    supervisely.SOURCE: (supervisely.supervisely_records, "humans-in-the-loop"),
}


def register(source, loader, folder):
    """Add or replace the loader of a corpus."""
    LOADERS[source] = (loader, folder)
