"""Harmonising source classes through two small mapping tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary import schemas
from annotary.checks import (
    TaxonomyConfigError,
    UnknownClassError,
    UnknownSourceError,
    Watch,
    require_empty,
    stop_if,
)
from annotary.session import join_null_safe, sized

# Rule vocabularies and the coarse class order of the masks.
DECISIONS = ["map", "keep_specific", "exclude"]
SIZES = ["large", "fine"]
SNAKE_CASE = r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"
COARSE_CLASSES = ["background", "large", "fine"]

# The harmonised classes (name, group, size) ...
DAMAGE_CLASSES = [
    ("scratch", "surface", "fine"),
    ("dent", "deformation", "fine"),
    ("crack", "rupture", "fine"),
    ("tear", "rupture", "fine"),
    ("puncture", "rupture", "fine"),
    ("broken_part", "rupture", "large"),
    ("glass_shatter", "vitrage", "large"),
    ("lamp_broken", "optique", "large"),
    ("tire_flat", "pneumatique", "large"),
    ("missing_part", "perte_de_piece", "large"),
    ("paint_chip", "surface", "fine"),
    ("flaking", "surface", "fine"),
    ("corrosion", "surface", "fine"),
]
# ... and the arbitration of every source class (source, class, canonical, decision).
DAMAGE_MAPPINGS = [
    ("vehide", "tray_son", "scratch", "map"),
    ("vehide", "mop_lom", "dent", "map"),
    ("vehide", "rach", "tear", "keep_specific"),
    ("vehide", "mat_bo_phan", "missing_part", "map"),
    ("vehide", "be_den", "lamp_broken", "map"),
    ("vehide", "thung", "puncture", "keep_specific"),
    ("vehide", "vo_kinh", "glass_shatter", "map"),
    ("cardd", "dent", "dent", "map"),
    ("cardd", "scratch", "scratch", "map"),
    ("cardd", "crack", "crack", "map"),
    ("cardd", "glass shatter", "glass_shatter", "map"),
    ("cardd", "lamp broken", "lamp_broken", "map"),
    ("cardd", "tire flat", "tire_flat", "map"),
    ("hitl", "Scratch", "scratch", "map"),
    ("hitl", "Dent", "dent", "map"),
    ("hitl", "Broken part", "broken_part", "keep_specific"),
    ("hitl", "Paint chip", "paint_chip", "keep_specific"),
    ("hitl", "Missing part", "missing_part", "map"),
    ("hitl", "Flaking", "flaking", "keep_specific"),
    ("hitl", "Corrosion", "corrosion", "keep_specific"),
    ("hitl", "Cracked", "crack", "map"),
]


def damage_taxonomy(spark: SparkSession):
    """The built-in ``(canonical_classes, class_mappings)`` pair."""
    classes = [(n, n.replace("_", " "), g, s) for n, g, s in DAMAGE_CLASSES]
    mappings = [(*row, f"{row[1]} read as {row[2]}") for row in DAMAGE_MAPPINGS]
    return (
        spark.createDataFrame(classes, schemas.CANONICAL_CLASSES),
        spark.createDataFrame(mappings, schemas.CLASS_MAPPINGS),
    )


def taxonomy_violations(canonical: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every broken rule as ``(rule, item)``; a sound taxonomy gives no row."""

    def blank(col):
        return F.coalesce(F.trim(F.col(col)), F.lit("")) == ""

    item = F.concat_ws("/", "source", "source_class")
    targets = canonical.select(F.col("name").alias("canonical"))
    found = [
        (canonical, ~F.coalesce(F.col("name").rlike(SNAKE_CASE), F.lit(False)), "name is not snake_case", F.col("name")),
        (canonical, blank("description") | blank("group"), "description or group is empty", F.col("name")),
        (canonical, F.col("size").isNotNull() & ~F.col("size").isin(SIZES), "size is neither large nor fine", F.col("name")),
        (mappings, ~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False)), "unknown decision", item),
        (mappings, blank("note"), "note is empty", item),
        (mappings, (F.col("decision") == "exclude") & F.col("canonical").isNotNull(), "excluded class has a canonical", item),
        (mappings, (F.col("decision") != "exclude") & F.col("canonical").isNull(), "canonical is missing", item),
        (
            mappings.filter(F.col("canonical").isNotNull() & (F.col("decision") != "exclude")).join(
                targets, "canonical", "left_anti"
            ),
            F.lit(True),
            "canonical is unknown",
            item,
        ),
    ]
    out = None
    for frame, test, rule, what in found:
        part = frame.filter(test).select(F.lit(rule).alias("rule"), what.alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def require_valid_taxonomy(canonical: DataFrame, mappings: DataFrame) -> None:
    if not canonical.take(1) or not mappings.take(1):
        raise TaxonomyConfigError("canonical classes and mappings must both be non-empty")
    require_empty(taxonomy_violations(canonical, mappings), "taxonomy", TaxonomyConfigError)


def observed_classes(instances: DataFrame) -> DataFrame:
    return instances.select("source", "source_class").distinct()


def unmapped_classes(instances: DataFrame, mappings: DataFrame) -> DataFrame:
    """Observed classes without an entry; ``kind`` tells source from class."""
    missing = observed_classes(instances).join(
        mappings.select("source", "source_class").distinct(),
        ["source", "source_class"],
        "left_anti",
    )
    known = mappings.select("source").distinct().withColumn("_known", F.lit(True))
    return missing.join(known, "source", "left").select(
        "source",
        "source_class",
        F.when(F.col("_known"), "unknown class").otherwise("unknown source").alias("kind"),
    )


def require_coverage(instances: DataFrame, mappings: DataFrame) -> None:
    """Two different errors: a source nobody knows, a class nobody arbitrated.

    One narrow pass over the instances; what is missing is kept, and asked for both.
    """
    missing = sized(unmapped_classes(instances, mappings)).orderBy("source", "source_class")
    if missing.isEmpty():
        return
    known = [row[0] for row in mappings.select("source").distinct().orderBy("source").collect()]
    require_empty(
        missing.filter(F.col("kind") == "unknown source"),
        f"taxonomy coverage (known sources: {known})",
        UnknownSourceError,
    )
    require_empty(missing, "taxonomy coverage", UnknownClassError)


def _arbitrated(instances: DataFrame, mappings: DataFrame) -> DataFrame:
    """Instances with ``canonical``, ``_decision`` and ``_known`` (source); all null where nothing is known."""
    entries = sized(mappings.select("source", "source_class", "canonical", F.col("decision").alias("_decision")))
    known = sized(mappings.select("source").distinct().withColumn("_known", F.lit(True)))
    return instances.join(entries, ["source", "source_class"], "left").join(known, "source", "left")


def _named():
    return F.concat_ws("/", F.coalesce("source", F.lit("null")), F.coalesce("source_class", F.lit("null")))


def harmonise(instances: DataFrame, mappings: DataFrame, within=False) -> DataFrame:
    """Add ``canonical``; excluded classes drop the instance, never the image.

    An unmapped class stops the job. The check is a pass of its own, before
    anything else; ``within`` leaves it to the job that uses the result, which
    reads the instances once and stops at the first unmapped one.
    """
    if not within:
        require_coverage(instances, mappings)
        table = sized(mappings.filter(F.col("decision") != "exclude").select("source", "source_class", "canonical"))
        return instances.join(table, ["source", "source_class"])
    missing = F.col("_decision").isNull()
    kind = F.when(F.col("_known"), "unknown class").otherwise("unknown source")
    decision = stop_if(missing, F.concat(F.lit("taxonomy coverage: "), kind, F.lit(" "), _named()), F.col("_decision"))
    return _arbitrated(instances, mappings).filter(decision != "exclude").drop("_decision", "_known")


def harmonise_watched(instances: DataFrame, mappings: DataFrame):
    """``(harmonised, watch)``: as ``harmonise``, but unmapped instances are left out and counted on the way.

    After the first action on the result, ``watch.require()`` raises the same
    errors as ``harmonise``; nothing is read twice.
    """
    missing = F.col("_decision").isNull()
    watch = Watch(
        ("taxonomy coverage, unknown source", missing & F.col("_known").isNull(), _named(), UnknownSourceError),
        ("taxonomy coverage, unknown class", missing, _named(), UnknownClassError),
    )
    read = watch.on(_arbitrated(instances, mappings))
    return read.filter(F.col("_decision") != "exclude").drop("_decision", "_known"), watch


def map_with(instances: DataFrame, mapping_fn) -> DataFrame:
    """Harmonise through a Python callable ``class -> name or None``.

    The callable sees each distinct class once, a null one included; the
    result is joined back null-safe, so a null class it maps keeps its rows.
    """
    as_udf = F.udf(mapping_fn, "string")
    table = sized(
        instances.select("source_class").distinct().withColumn("canonical", as_udf("source_class"))
    ).filter(F.col("canonical").isNotNull())
    return join_null_safe(instances, table, ["source_class"])


def with_coarse_class(instances: DataFrame, canonical: DataFrame, check=True, within=False) -> DataFrame:
    """Add ``group``, ``size`` and ``class_index`` from the canonical name.

    The index comes from the fixed order background, large, fine: never from
    ids local to a file. A class without size is an error here: found by one
    pass over the names before anything else, or, with ``within``, by the job
    that uses the result.
    """
    table = sized(canonical.select(F.col("name").alias("canonical"), "group", "size"))
    joined = instances.join(table, "canonical", "left")
    order = F.array(*[F.lit(name) for name in COARSE_CLASSES])
    index = (F.array_position(order, F.col("size")) - 1).cast("int")
    unknown, sizeless = F.col("group").isNull(), F.col("size").isNull()
    if check and within:
        name = F.coalesce("canonical", F.lit("null"))
        index = stop_if(unknown, F.concat(F.lit("unknown canonical class: "), name), index)
        index = stop_if(sizeless & ~unknown, F.concat(F.lit("canonical class without size: "), name), index)
    elif check:
        names = sized(instances.select("canonical").distinct().join(table, "canonical", "left").filter(unknown | sizeless))
        require_empty(names.filter(unknown), "unknown canonical class", UnknownClassError)
        require_empty(names, "canonical class without size", TaxonomyConfigError)
    return joined.withColumn("class_index", index)


def shared_classes(mappings: DataFrame) -> DataFrame:
    """Per canonical class the number of sources that map to it."""
    return (
        mappings.filter(F.col("decision") == "map")
        .groupBy("canonical")
        .agg(F.countDistinct("source").alias("n_sources"))
    )
