"""Geometry, cleaning, taxonomy, statistics, export and format queries."""

from pyspark.sql import functions as F

from annotary import schemas
from annotary.functions import geometry as g
from annotary.functions import naming
from annotary.operators import coco, records, stats, taxonomy
from annotary.plans import sql, standin
from annotary.plans.catalog import CATALOG, query
from annotary.session import scratch_path, shuffles_freed, sized
from annotary.sources import coco as coco_source
from annotary.sources import images as image_source
from annotary.sources import document, sinks, supervisely, via

# -- geometry ------------------------------------------------------------------


def _rings(spark, sf_dir):
    return standin.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("ring"),
    )


_POINTS = """points AS (
  SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y,
         CAST(embedding[2 * ((i + 1) % n) + 1] AS DOUBLE) AS x2,
         CAST(embedding[2 * ((i + 1) % n) + 2] AS DOUBLE) AS y2
  FROM (SELECT vec_id, embedding, len(embedding) // 2 AS n,
               unnest(range(len(embedding) // 2)) AS i FROM embeddings))"""


@query(f"""WITH {_POINTS}
SELECT vec_id, round(abs(sum(x * y2 - x2 * y)) / 2, 6) AS area FROM points GROUP BY 1""")
def ring_area(spark, sf_dir):
    return _rings(spark, sf_dir).select("vec_id", F.round(g.ring_area("ring"), 6).alias("area"))


@query(f"""WITH {_POINTS}
SELECT vec_id, round(min(x), 6) AS x, round(min(y), 6) AS y,
       round(max(x) - min(x), 6) AS w, round(max(y) - min(y), 6) AS h FROM points GROUP BY 1""")
def ring_bbox(spark, sf_dir):
    box = _rings(spark, sf_dir).select("vec_id", g.ring_bbox("ring").alias("b"))
    return box.select(
        "vec_id", *[F.round(F.get("b", k), 6).alias(n) for k, n in enumerate(["x", "y", "w", "h"])]
    )


@query("""SELECT vec_id, 2 * i + side AS place,
       round(CAST(CASE side WHEN 0 THEN embedding[i + 1] ELSE embedding[i + 33] END AS DOUBLE), 6) AS v
FROM (SELECT vec_id, embedding, unnest(range(32)) AS i FROM embeddings), (VALUES (0), (1)) s(side)""")
def interleave(spark, sf_dir):
    """First half of each vector as xs, second half as ys, zipped to a ring."""
    half = _rings(spark, sf_dir).select(
        "vec_id", F.slice("ring", 1, 32).alias("xs"), F.slice("ring", 33, 32).alias("ys")
    )
    ring = half.select("vec_id", F.posexplode(g.interleave("xs", "ys")).alias("place", "v"))
    return ring.select("vec_id", F.col("place").cast("long").alias("place"), F.round("v", 6).alias("v"))


@query("""SELECT o_orderkey,
  greatest(1, round_even(w * scale, 0)::INTEGER) AS new_w, greatest(1, round_even(h * scale, 0)::INTEGER) AS new_h,
  (512 - greatest(1, round_even(w * scale, 0)::INTEGER)) // 2 AS left_pad,
  (512 - greatest(1, round_even(h * scale, 0)::INTEGER)) // 2 AS top_pad
FROM (SELECT *, least(512::DOUBLE / w, 512::DOUBLE / h) AS scale FROM (
  SELECT o_orderkey, o_custkey % 1600 + 320 AS w, o_orderkey % 1200 + 240 AS h FROM orders))""")
def letterbox(spark, sf_dir):
    sized = standin.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 1600 + 320).alias("w"),
        (F.col("o_orderkey") % 1200 + 240).alias("h"),
    )
    box = g.letterbox("w", "h", 512)
    return sized.select("o_orderkey", box.alias("b")).select(
        "o_orderkey",
        F.col("b.new_w").alias("new_w"),
        F.col("b.new_h").alias("new_h"),
        F.col("b.left").alias("left_pad"),
        F.col("b.top").alias("top_pad"),
    )


# -- cleaning --------------------------------------------------------------------


POSITION = ["pos.l_linenumber", "pos.l_partkey", "pos.l_suppkey"]


def _sized_instances(spark, sf_dir):
    sizes = standin.images(spark, sf_dir).select("image_id", "source", "width", "height")
    # the box follows from the extent, so only the extent is moved
    cleaned = records.clean_instances(standin.instances(spark, sf_dir)).drop("bbox")
    return records.mark_out_of_frame(cleaned.join(sizes, "image_id")).withColumn("bbox", g.extent_bbox("extent"))


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}
SELECT image_id, l_linenumber, l_partkey, l_suppkey, source_class, x, y, w, h, w * h AS area
FROM boxes JOIN images USING (image_id)
WHERE w * h > 0 AND NOT (x >= width OR y >= height OR x + w <= 0 OR y + h <= 0)""")
def clean_polygons(spark, sf_dir):
    """Degenerate and out-of-frame polygons dropped; box and area of the rest."""
    kept = records.kept_instances(_sized_instances(spark, sf_dir))
    return kept.select(
        "image_id",
        *POSITION,
        "source_class",
        *[F.get("bbox", k).alias(n) for k, n in enumerate(["x", "y", "w", "h"])],
        "area",
    )


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}
SELECT source, count(*) AS n_read,
  count(*) FILTER (w * h = 0) AS degenerate_polygons,
  count(*) FILTER (w * h = 0 OR x >= width OR y >= height) AS dropped_instances,
  count(*) FILTER (l_tax = 0) AS interior_holes_dropped
FROM boxes JOIN images USING (image_id) GROUP BY 1""")
def drop_counters(spark, sf_dir):
    cleaned = _sized_instances(spark, sf_dir)
    return records.drop_counters(cleaned, holes="n_holes")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
areas AS (SELECT vec_id,
  abs((a[1]*a[4]-a[3]*a[2]) + (a[3]*a[6]-a[5]*a[4]) + (a[5]*a[8]-a[7]*a[6]) + (a[7]*a[2]-a[1]*a[8])) / 2 AS quad,
  CASE WHEN label < 3 THEN 0.0::DOUBLE ELSE
    abs((a[9]*a[12]-a[11]*a[10]) + (a[11]*a[14]-a[13]*a[12]) + (a[13]*a[10]-a[9]*a[14])) / 2 END AS tri
  FROM v),
sides AS (SELECT vec_id, a, unnest(range(25)) AS i FROM v),
rest AS (SELECT vec_id, abs(sum(a[15 + 2 * i] * a[16 + 2 * ((i + 1) % 25)] - a[15 + 2 * ((i + 1) % 25)] * a[16 + 2 * i])) / 2 AS big FROM sides GROUP BY 1)
SELECT vec_id, CAST(1 + (quad = 0)::INT + (tri = 0)::INT + (big = 0)::INT AS BIGINT) AS n_degenerate,
  quad = 0 AND tri = 0 AND big = 0 AS dropped, round(quad + tri + big, 5) AS area FROM areas JOIN rest USING (vec_id)""")
def clean_rings(spark, sf_dir):
    """Four rings per vector: a quadrangle, a two-point ring, a triangle that
    collapses to one point for small labels, and all the rest."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    point = F.slice("e", 9, 2)
    third = F.when(F.col("label") < 3, F.concat(point, point, point)).otherwise(F.slice("e", 9, 6))
    inst = (
        standin.table(spark, sf_dir, "embeddings")
        .withColumn("e", e)
        .select("vec_id", F.array(F.slice("e", 1, 8), F.slice("e", 1, 4), third, F.slice("e", 15, 50)).alias("polygon"))
    )
    return records.clean_instances(inst).select(
        "vec_id",
        F.col("n_degenerate").cast("long").alias("n_degenerate"),
        "dropped",
        F.round("area", 5).alias("area"),
    )


# -- taxonomy --------------------------------------------------------------------


def _mapping(spark, sources):
    """The six arbitrated classes for every source."""
    rows = [
        ("AF", "scratch", "map"),
        ("AO", "dent", "map"),
        ("NF", "crack", "keep_specific"),
        ("NO", "lamp_broken", "map"),
        ("RF", None, "exclude"),
        ("RO", None, "exclude"),
    ]
    return spark.createDataFrame(
        [(s, c, canonical, decision, "test entry") for s in sources for c, canonical, decision in rows],
        schemas.CLASS_MAPPINGS,
    )


SOURCES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _sourced(spark, sf_dir):
    sources = standin.images(spark, sf_dir).select("image_id", "source")
    return standin.instances(spark, sf_dir).select("image_id", "pos", "source_class").join(
        sources, "image_id"
    )


def _harmonised(spark, sf_dir):
    return taxonomy.harmonise(_sourced(spark, sf_dir), _mapping(spark, SOURCES), within=True)


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}, {sql.MAPPING}
SELECT image_id, l_linenumber, l_partkey, l_suppkey, source, canonical
FROM boxes JOIN images USING (image_id) JOIN mapping USING (source_class) WHERE decision <> 'exclude'""")
def harmonise(spark, sf_dir):
    return _harmonised(spark, sf_dir).select("image_id", *POSITION, "source", "canonical")


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}, {sql.MAPPING}
SELECT DISTINCT source, source_class,
  CASE WHEN source = '5-LOW' THEN 'unknown source' ELSE 'unknown class' END AS kind
FROM boxes JOIN images USING (image_id)
WHERE source = '5-LOW' OR source_class NOT IN (SELECT source_class FROM mapping WHERE source_class <> 'RO')""")
def coverage(spark, sf_dir):
    """One source without any entry, one class without an entry elsewhere."""
    entries = _mapping(spark, SOURCES[:-1]).filter(F.col("source_class") != "RO")
    return taxonomy.unmapped_classes(_sourced(spark, sf_dir), entries)


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}
SELECT DISTINCT source, source_class FROM boxes JOIN images USING (image_id)""")
def observed_classes(spark, sf_dir):
    return taxonomy.observed_classes(_sourced(spark, sf_dir))


@query(f"""WITH {sql.BOXES}, {sql.MAPPING}, canon(canonical, "group", size, class_index) AS (VALUES
  ('scratch', 'surface', 'fine', 2), ('dent', 'deformation', 'fine', 2),
  ('crack', 'rupture', 'fine', 2), ('lamp_broken', 'optique', 'large', 1))
SELECT "group", size, class_index, count(*) AS n FROM boxes JOIN mapping USING (source_class)
JOIN canon USING (canonical) GROUP BY ALL""")
def coarse_classes(spark, sf_dir):
    canonical, _ = taxonomy.damage_taxonomy(spark)
    coarse = taxonomy.with_coarse_class(_harmonised(spark, sf_dir).select("canonical"), canonical, within=True)
    return coarse.groupBy("group", "size", "class_index").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}, {sql.MAPPING}
SELECT canonical, {", ".join(f'''count(*) FILTER (source = '{s}') AS "{s}"''' for s in SOURCES)},
  count(*) AS total
FROM boxes JOIN images USING (image_id) JOIN mapping USING (source_class)
WHERE decision <> 'exclude' GROUP BY 1""")
def class_source_pivot(spark, sf_dir):
    return stats.class_source_pivot(_harmonised(spark, sf_dir), SOURCES)


@query("""WITH seen AS (SELECT DISTINCT lang AS source, source AS source_class FROM documents),
maps AS (SELECT source, source_class, 'c' || CAST(substr(source_class, 4) AS INTEGER) % 7 AS canonical,
  CASE WHEN source_class IN ('src3', 'src4') THEN 'keep_specific' ELSE 'map' END AS decision FROM seen)
SELECT canonical, count(DISTINCT source) AS n_sources FROM maps WHERE decision = 'map' GROUP BY 1""")
def shared_classes(spark, sf_dir):
    """Languages as sources, document origins as their classes."""
    number = F.substring("source_class", 4, 10).cast("int") % 7
    maps = (
        standin.table(spark, sf_dir, "documents")
        .select(F.col("lang").alias("source"), F.col("source").alias("source_class"))
        .distinct()
        .withColumn("canonical", F.concat(F.lit("c"), number.cast("string")))
        .withColumn(
            "decision",
            F.when(F.col("source_class").isin("src3", "src4"), "keep_specific").otherwise("map"),
        )
    )
    return taxonomy.shared_classes(maps)


# -- statistics ------------------------------------------------------------------


_STATS = f"""WITH {sql.IMAGES}, {sql.BOXES},
classes AS (SELECT image_id, count(*) AS n, string_agg(DISTINCT source_class, '|' ORDER BY source_class) AS classes
            FROM boxes GROUP BY 1),
stats AS (
  SELECT image_id, source, width, height, width::DOUBLE * height / 1e6::DOUBLE AS megapixels,
         coalesce(n, 0) AS n_instances, coalesce(classes, '') AS classes
  FROM images LEFT JOIN classes USING (image_id))"""


def _stats(spark, sf_dir):
    classes = standin.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("img/"), F.col("l_orderkey").cast("string")).alias("image_id"),
        F.concat("l_returnflag", "l_linestatus").alias("source_class"),
    )
    return stats.image_stats_flat(standin.images(spark, sf_dir), classes)


@query(_STATS + """
SELECT image_id, source, width, height, round(megapixels, 6) AS megapixels, n_instances,
       round(n_instances / megapixels, 6) AS instances_per_megapixel, classes FROM stats""")
def per_image_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "image_id", "source", "width", "height", F.round("megapixels", 6).alias("megapixels"),
        "n_instances", F.round("instances_per_megapixel", 6).alias("instances_per_megapixel"), "classes",
    )


_SOURCE_STATS = _STATS + """
SELECT source, count(*) AS n_images, CAST(sum(n_instances) AS BIGINT) AS n_instances,
  round(avg(n_instances), 6) AS density, round(avg(megapixels), 6) AS mean_megapixels,
  (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(classes, '|')) AS c, s2.source AS s
     FROM stats s2) WHERE c <> '' AND s = stats.source) AS n_classes
FROM stats GROUP BY 1"""


def _rounded_sources(df):
    return df.select(
        "source", "n_images", "n_instances", F.round("density", 6).alias("density"),
        F.round("mean_megapixels", 6).alias("mean_megapixels"), "n_classes",
    )


@query(_SOURCE_STATS)
def per_source_stats(spark, sf_dir):
    return _rounded_sources(stats.source_stats(_stats(spark, sf_dir)))


@query(_SOURCE_STATS)
def stats_table(spark, sf_dir):
    """Statistics written as Parquet, then aggregated from the written table."""
    path = scratch_path(spark, "stats")
    sinks.write_stats(_stats(spark, sf_dir), path)
    return _rounded_sources(stats.source_stats(spark.read.parquet(path)))


@query(f"""WITH {sql.COUNTED}, {sql.split()}
SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
       count(*) FILTER (split = 'test') AS test
FROM counted JOIN assignment USING (group_id) GROUP BY 1""")
def split_source_counts(spark, sf_dir):
    from annotary.operators.split import group_split

    return stats.split_source_counts(group_split(standin.counted_images(spark, sf_dir), seed=42))


@query(f"""WITH {sql.COUNTED}, binned AS (SELECT source, least(n_instances, 12) AS bin, n_instances FROM counted),
means AS (SELECT source, avg(n_instances) AS mean, count(*) AS n FROM binned GROUP BY 1)
SELECT source, bin, count(*) AS n_images, round(count(*) / any_value(n), 6) AS share,
  round(any_value(mean), 6) AS mean_instances FROM binned JOIN means USING (source) GROUP BY 1, 2""")
def density_hist(spark, sf_dir):
    hist = stats.density_histogram(standin.counted_images(spark, sf_dir))
    return hist.select(
        "source", F.col("bin").cast("long").alias("bin"), "n_images", F.round("share", 6).alias("share"),
        F.round("mean_instances", 6).alias("mean_instances"),
    )


@query("""WITH edges AS (
  SELECT ln(greatest(min(o_totalprice), 0.01) * 0.95) AS a, ln(max(o_totalprice) * 1.05) AS b FROM orders),
binned AS (SELECT o_orderpriority AS source, o_totalprice AS v,
  CAST(floor((ln(o_totalprice) - a) / (b - a) * 39) AS BIGINT) AS bin FROM orders, edges),
whole AS (SELECT source, count(*) AS c, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM binned GROUP BY 1)
SELECT source, bin, count(*) AS n, round(count(*) / any_value(c), 6) AS share,
  round(any_value(mean), 4) AS mean, any_value(lo) AS min, any_value(hi) AS max
FROM binned JOIN whole USING (source) GROUP BY 1, 2""")
def log_hist(spark, sf_dir):
    orders = standin.table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    hist = stats.log_histogram(orders, "o_totalprice", "o_orderpriority")
    return hist.select(
        "source", "bin", "n", F.round("share", 6).alias("share"), F.round("mean", 4).alias("mean"),
        "min", "max",
    )


@query(f"""WITH {sql.IMAGES}, {sql.BOXES},
kept AS (SELECT source, count(*) AS n_instances, count(*) FILTER (w = 0) AS dropped
         FROM boxes JOIN images USING (image_id) GROUP BY 1),
bad AS (SELECT source, count(*) AS n FROM images WHERE file_path LIKE '%/P/%' GROUP BY 1),
t AS (
  SELECT k.source, i.n AS n_images, i.n + CASE WHEN k.source < '3' THEN b.n ELSE 0 END AS expected_images,
    b.n AS corrupted_images, k.n_instances - dropped AS n_instances,
    k.n_instances + CASE WHEN k.source > '4' THEN 5 ELSE 0 END AS expected_instances,
    dropped AS dropped_instances
  FROM kept k JOIN (SELECT source, count(*) AS n FROM images GROUP BY 1) i USING (source) JOIN bad b USING (source))
SELECT source, expected_images - n_images AS image_gap,
  CASE WHEN expected_images = n_images THEN 'exact'
       WHEN expected_images - n_images = corrupted_images THEN 'explained' ELSE 'unexplained' END AS image_status,
  expected_instances - n_instances AS instance_gap,
  expected_instances - n_instances - dropped_instances AS instance_unexplained,
  CASE WHEN expected_instances = n_instances THEN 'exact'
       WHEN expected_instances - n_instances = dropped_instances THEN 'explained' ELSE 'unexplained' END AS instance_status
FROM t""")
def control_reconcile(spark, sf_dir):
    """Controls made from the tables: one corpus short of its corrupted images,
    one with five instances nothing explains."""
    images = standin.images(spark, sf_dir)
    lines = standin.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("img/"), F.col("l_orderkey").cast("string")).alias("image_id"),
        (F.col("l_discount") == 0).cast("long").alias("drop"),
    )
    per_line = lines.join(images.select("image_id", "source"), "image_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("drop").alias("dropped_instances")
    )
    per_image = images.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count(F.when(F.col("file_path").contains("/P/"), 1)).alias("corrupted_images"),
    )
    both = per_line.join(per_image, "source")
    actual = both.select("source", "n_images", (F.col("n") - F.col("dropped_instances")).alias("n_instances"))
    drops = both.select(
        "source", "dropped_instances", "corrupted_images", F.lit(0).cast("long").alias("corrupted_instances")
    )
    controls = both.select(
        "source",
        (F.col("n_images") + F.when(F.col("source") < "3", F.col("corrupted_images")).otherwise(0)).alias("expected_images"),
        (F.col("n") + F.when(F.col("source") > "4", 5).otherwise(0)).alias("expected_instances"),
    )
    return stats.reconcile(actual, drops, controls).select(
        "source", "image_gap", "image_status", "instance_gap", "instance_unexplained", "instance_status"
    )


# -- COCO export -----------------------------------------------------------------

_COCO = f"""WITH {sql.IMAGES}, {sql.BOXES}, {sql.MAPPING},
kept AS (SELECT boxes.*, canonical FROM boxes JOIN mapping USING (source_class) WHERE decision <> 'exclude'),
cats AS (SELECT canonical, row_number() OVER (ORDER BY canonical) AS id FROM (SELECT DISTINCT canonical FROM kept)),
ids AS (SELECT *, row_number() OVER (ORDER BY image_id) AS id FROM images)"""


@query(_COCO + """
SELECT id, o.file_name, width, height, source, ids.image_id AS origin_image_id, group_id, ids.file_path AS origin_file_path
FROM ids, LATERAL (SELECT split_part(file_path, '/', -1) AS file_name) o""")
def coco_images(spark, sf_dir):
    images = standin.images(spark, sf_dir)
    return coco.image_table(images, coco.image_ids(images))


def _mapped_boxes(spark, sf_dir):
    cleaned = records.clean_instances(standin.instances(spark, sf_dir))
    mapping = _mapping(spark, ["any"])
    return taxonomy.harmonise(cleaned.withColumn("source", F.lit("any")), mapping, within=True)


@query(_COCO + """
SELECT row_number() OVER (ORDER BY ids.image_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
  ids.id AS image_id, CAST(cats.id AS INTEGER) AS category_id, w * h AS area, 0 AS iscrowd,
  CASE WHEN w * h > 0 THEN x END AS x, CASE WHEN w * h > 0 THEN y END AS y, CASE WHEN w * h > 0 THEN w END AS w,
  CASE WHEN w * h > 0 THEN h END AS h,
  CASE WHEN w * h > 0 THEN concat_ws(' ', x::INT, y::INT, (x + w)::INT, y::INT, (x + w)::INT, (y + h)::INT, x::INT, (y + h)::INT)
    ELSE '' END AS segmentation
FROM kept JOIN ids USING (image_id) JOIN cats USING (canonical)""")
def coco_annotations(spark, sf_dir):
    """Every column of the annotations; polygons as the text of their coordinates."""
    images, inst = standin.images(spark, sf_dir), sized(_mapped_boxes(spark, sf_dir))
    table = coco.annotation_table(inst, images, coco.category_table(inst))
    return table.select(
        "id",
        "image_id",
        "category_id",
        F.coalesce("area", F.lit(0.0)).alias("area"),
        "iscrowd",
        *[F.get("bbox", k).alias(n) for k, n in enumerate(["x", "y", "w", "h"])],
        F.array_join(F.transform(F.flatten("segmentation"), lambda v: v.cast("bigint").cast("string")), " ").alias("segmentation"),
    )


@query(_COCO + """
SELECT row_number() OVER (ORDER BY ids.image_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
  ids.image_id AS origin_image_id, ids.file_path AS origin_file_path, split_part(ids.file_path, '/', -1) AS file_name,
  ids.width, ids.height, ids.source, ids.group_id, ids.split_hint AS split, canonical, w * h AS area,
  CASE WHEN w * h > 0 THEN concat_ws(' ', x::INT, y::INT, w::INT, h::INT) ELSE '' END AS bbox,
  CASE WHEN w * h > 0 THEN concat_ws(' ', x::INT, y::INT, (x + w)::INT, y::INT, (x + w)::INT, (y + h)::INT, x::INT, (y + h)::INT)
    ELSE '' END AS segmentation
FROM kept JOIN ids USING (image_id)""")
def coco_document_roundtrip(spark, sf_dir):
    """The whole corpus exported as one COCO document and read again, every member compared."""
    images, inst = standin.images(spark, sf_dir), sized(_mapped_boxes(spark, sf_dir))
    triple = coco.coco_triple(images.withColumnRenamed("split_hint", "split"), inst)
    path = scratch_path(spark, "document")
    sinks.write_coco_document(*triple, path, "gzip")
    images, annotations, categories = document.read_coco_document(spark, path)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("bigint").cast("string")), " ")
    return (
        annotations.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("canonical")), "category_id")
        .join(images.withColumnRenamed("id", "image_id"), "image_id")
        .select(
            "id",
            "origin_image_id",
            "origin_file_path",
            "file_name",
            "width",
            "height",
            "source",
            "group_id",
            "split",
            "canonical",
            F.coalesce("area", F.lit(0.0)).alias("area"),
            F.coalesce(text("bbox"), F.lit("")).alias("bbox"),
            text(F.flatten("segmentation")).alias("segmentation"),
        )
    )


@query(_COCO + """
SELECT CAST(id AS INTEGER) AS id, canonical AS name, 'damage' AS supercategory FROM cats""")
def coco_categories(spark, sf_dir):
    return coco.category_table(_harmonised(spark, sf_dir))


@query("""SELECT split_part(url, '/', 3) AS image_id, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    """Hosts as keys: those of more than one page repeat."""
    pages = standin.table(spark, sf_dir, "pages").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("image_id")
    )
    return coco.duplicate_ids(pages)


# -- paths and names ---------------------------------------------------------------


@query(r"""SELECT page_id, 'web/' || regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS image_id
FROM (SELECT page_id, split_part(url, '/', -1) AS name FROM pages)""")
def stable_ids(spark, sf_dir):
    return standin.table(spark, sf_dir, "pages").select(
        "page_id", naming.image_key(F.lit("web"), "url").alias("image_id")
    )


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '/data/' || o_orderkey || '.jpg'
  ELSE '/abs/' || o_orderstatus || '/' || o_orderkey || '.jpg' END AS resolved_path FROM orders""")
def resolve_paths(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    images = standin.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(key, F.lit(".jpg")).alias("file_name"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.concat(F.lit("/abs/"), "o_orderstatus", F.lit("/"), key, F.lit(".jpg")),
        ).alias("source_file_path"),
    )
    return records.resolve_paths(images, "/data/").select("o_orderkey", "resolved_path")


@query("""SELECT o_orderkey || '.jpg' AS file_name, CASE
  WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN '/mirror/' || o_orderkey || '.jpg'
  WHEN o_orderstatus IN ('F', 'O') THEN '/corpus/' || o_orderstatus || '/' || o_orderkey || '.jpg' END AS path
FROM orders""")
def first_existing(spark, sf_dir):
    """Recent files lie on a mirror as well; pending ones only there."""
    orders = standin.table(spark, sf_dir, "orders")
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    main = standin.images(spark, sf_dir).select(F.col("file_path").alias("path"))
    recent = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    mirror = orders.filter(recent).select(F.concat(F.lit("/mirror/"), name).alias("path"))
    names = orders.select(name.alias("file_name"))
    return image_source.first_existing(
        names, main.unionByName(mirror), ["/mirror", "/corpus/F", "/corpus/O"]
    )


# -- formats -----------------------------------------------------------------------


@query("""SELECT key, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (
  SELECT unnest(json_keys(props)) AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events)
GROUP BY 1""")
def json_map_scan(spark, sf_dir):
    entries = standin.table(spark, sf_dir, "events").select(
        F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v")
    )
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _lines_by_order(spark, sf_dir, item):
    """Orders with an array of one struct per line item, as the nested formats
    need it: an annotation file is one image. Lines are moved to their order as they are
    and become structs there."""
    lines = (
        standin.table(spark, sf_dir, "lineitem")
        .select(*_LINE)
        .repartition("l_orderkey")
        .select(F.col("l_orderkey").alias("o_orderkey"), item.alias("item"))
        .groupBy("o_orderkey")
        .agg(F.collect_list("item").alias("items"))
    )
    return _order_sizes(spark, sf_dir).join(lines, "o_orderkey", "left").withColumn("items", F.coalesce("items", F.expr("array()")))


def _order_sizes(spark, sf_dir):
    return standin.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("name"),
        (F.col("o_custkey") % 1600 + 320).cast("int").alias("width"),
        (F.col("o_orderkey") % 1200 + 240).cast("int").alias("height"),
    )


def _corners():
    """x and y of the four corners of a line's rectangle."""
    x, y = (F.col("l_partkey") % 1000).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    w, h = F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")), (F.col("l_linenumber") * 3).cast("double")
    return [x, x + w, x + w, x], [y, y, y + h, y + h]


def _class():
    return F.concat("l_returnflag", "l_linestatus")


def _summary(df, *more):
    return df.select(
        *more,
        "file_name",
        F.size("instances").cast("long").alias("n_instances"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.round(F.aggregate("instances", F.lit(0.0), lambda a, i: a + i["area"]), 4).alias("area"),
    )


_KEPT = """FROM images LEFT JOIN boxes USING (image_id) GROUP BY 1"""


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}
SELECT replace(image_id, 'img/', '') || '.jpg' AS file_name,
  count(*) FILTER (w > 0 AND x < width AND y < height) AS n_instances,
  count(*) FILTER (w IS NOT NULL AND NOT (w > 0 AND x < width AND y < height)) AS n_dropped,
  round(coalesce(sum(w * h) FILTER (w > 0 AND x < width AND y < height), 0), 4) AS area {_KEPT}""")
def via_scan(spark, sf_dir):
    """VIA maps, one image per line, written and scanned back."""
    return _via(spark, sf_dir)


@query(CATALOG["via_scan"].sql)
def via_document_split(spark, sf_dir):
    """One VIA document of all images, read by many tasks."""
    return _via(spark, sf_dir, split=True)


def _via(spark, sf_dir, split=False):
    xs, ys = _corners()
    region = F.struct(F.array(*xs).alias("all_x"), F.array(*ys).alias("all_y"), _class().alias("class"))
    orders = _lines_by_order(spark, sf_dir, region)
    path = scratch_path(spark, "via")
    maps = orders.select(
        "name", F.to_json(F.create_map("name", F.struct("name", F.col("items").alias("regions")))).alias("value")
    )
    if split:  # the maps as members of one, in lines that make one document
        last = _order_sizes(spark, sf_dir).agg(F.max("name")).first()[0]
        member = F.expr("substring(value, 2, length(value) - 2)")
        body = maps.select(F.lit(1).alias("k"), "name", F.concat(member, F.when(F.col("name") < last, ",").otherwise("")).alias("value"))
        ends = spark.createDataFrame([(0, "", "{"), (2, "", "}")], body.schema)
        sinks.write_ordered_text(body.union(ends), ["k", "name"], path, "gzip")
    else:
        with shuffles_freed(spark):
            maps.select("value").write.option("compression", "gzip").option("maxRecordsPerFile", sinks.FILE_LINES).text(path)
    sizes = standin.images(spark, sf_dir).select(
        naming.basename("file_path").alias("file_name"), "width", "height"
    )
    return _summary(via.via_instances(via.via_entries(spark, path, lines=not split, split=split).join(sizes, "file_name")))


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}
SELECT replace(image_id, 'img/', '') || '.jpg' AS file_name,
  count(*) FILTER (w > 0) AS n_instances, count(*) FILTER (w = 0) AS n_dropped,
  round(coalesce(sum(w * h) FILTER (w > 0), 0), 4) AS area {_KEPT}""")
def coco_scan(spark, sf_dir):
    """Partial COCO documents, one per line, written and scanned back."""
    return _coco_lines(spark, sf_dir)


@query(CATALOG["coco_scan"].sql)
def coco_document_split(spark, sf_dir):
    """The same corpus as one COCO document, read by many tasks."""
    return _coco_lines(spark, sf_dir, split=True)


def _coco_lines(spark, sf_dir, split=False):
    names = ["AF", "AO", "NF", "NO", "RF", "RO"]
    ann = [
        (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")).alias("id"),
        F.col("l_orderkey").alias("image_id"),
        F.array_position(F.array(*[F.lit(c) for c in names]), _class()).cast("int").alias("category_id"),
        F.array(F.array(*[v for point in zip(*_corners()) for v in point])).alias("segmentation"),
        F.lit(0).alias("iscrowd"),
    ]
    image = [F.col("o_orderkey").alias("id"), "width", "height", F.col("name").alias("file_name")]
    categories = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(c).alias("name")) for k, c in enumerate(names, 1)])
    path = scratch_path(spark, "coco")
    if split:
        orders, lines = _order_sizes(spark, sf_dir), standin.table(spark, sf_dir, "lineitem")
        named = orders.select(F.inline(categories)).distinct()
        sinks.write_coco_document(orders.select(*image), lines.select(*ann), named, path, "gzip")
    else:
        docs = _lines_by_order(spark, sf_dir, F.struct(*ann)).select(
            F.array(F.struct(*image)).alias("images"), F.col("items").alias("annotations"), categories.alias("categories")
        )
        with shuffles_freed(spark):
            docs.write.option("compression", "gzip").option("maxRecordsPerFile", sinks.FILE_LINES).json(path)
    images, inst = coco_source.coco_flat(
        coco_source.coco_documents(spark, path, lines=not split, split=split), "train", "/corpus/train"
    )
    counted = images.join(
        inst.groupBy("image_id").agg(
            F.count(F.when(~F.col("dropped"), 1)).alias("n"),
            F.count(F.when(F.col("dropped"), 1)).alias("d"),
            F.sum(F.when(~F.col("dropped"), F.col("area"))).alias("a"),
        ),
        "image_id",
        "left",
    )
    return counted.select(
        naming.basename("file_path").alias("file_name"),
        F.coalesce("n", F.lit(0)).alias("n_instances"),
        F.coalesce("d", F.lit(0)).alias("n_dropped"),
        F.round(F.coalesce("a", F.lit(0.0)), 4).alias("area"),
    )


@query(f"""WITH {sql.IMAGES}, {sql.BOXES}
SELECT replace(image_id, 'img/', '') || '.jpg' AS file_name,
  count(*) FILTER (w > 0) AS n_instances, count(*) FILTER (w = 0) AS n_dropped,
  round(coalesce(sum(w * h) FILTER (w > 0), 0), 4) AS area,
  count(*) FILTER (w > 0 AND l_tax = 0) AS n_holes {_KEPT}""")
def supervisely_scan(spark, sf_dir):
    """Supervisely annotations, one image per line, written and scanned back."""
    points = F.array(*[F.array(x, y) for x, y in zip(*_corners())])
    pick = F.array(*[F.lit(c) for c in supervisely.CLASSES])
    obj = F.struct(
        F.col("l_partkey").alias("id"),
        F.get(pick, (F.col("l_linenumber") % len(supervisely.CLASSES)).cast("int")).alias("classTitle"),
        F.lit("polygon").alias("geometryType"),
        F.struct(
            points.alias("exterior"),
            F.when(F.col("l_tax") == 0, F.array(F.slice(points, 1, 3)))
            .otherwise(F.array().cast("array<array<array<double>>>"))
            .alias("interior"),
        ).alias("points"),
    )
    path = scratch_path(spark, "supervisely")
    _lines_by_order(spark, sf_dir, obj).select(
        "name", F.col("items").alias("objects"), F.struct("height", "width").alias("size")
    ).write.json(path)
    read = supervisely.supervisely_instances(supervisely.supervisely_objects(spark, path, lines=True))
    return _summary(read, F.col("n_holes").cast("long").alias("n_holes"))
