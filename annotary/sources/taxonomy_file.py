"""Taxonomy from a YAML file (a small configuration, read on the driver)."""

from pyspark.sql import SparkSession

from annotary import schemas
from annotary.checks import TaxonomyConfigError
from annotary.operators.taxonomy import require_valid_taxonomy


def _text(value):
    """Trimmed text, or None when there is none."""
    return value.strip() or None if isinstance(value, str) else None


def load_taxonomy(spark: SparkSession, path):
    """``(canonical_classes, class_mappings)``, validated."""
    try:
        import yaml
    except ImportError as error:  # pragma: no cover
        raise RuntimeError("reading a YAML taxonomy needs PyYAML") from error
    with open(path, encoding="utf-8") as handle:
        doc = yaml.safe_load(handle) or {}
    classes, sources = doc.get("canonical_classes"), doc.get("sources")
    if not isinstance(classes, dict) or not isinstance(sources, dict) or not classes or not sources:
        raise TaxonomyConfigError("canonical_classes and sources must be non-empty mappings")
    canonical = spark.createDataFrame(
        [
            (name, _text(body.get("description")), _text(body.get("group")), _text(body.get("size")))
            for name, body in classes.items()
        ],
        schemas.CANONICAL_CLASSES,
    )
    mappings = spark.createDataFrame(
        [
            (source, name, _text(body.get("canonical")), _text(body.get("decision")), _text(body.get("note")))
            for source, entries in sources.items()
            for name, body in entries.items()
        ],
        schemas.CLASS_MAPPINGS,
    )
    require_valid_taxonomy(canonical, mappings)
    return canonical, mappings
