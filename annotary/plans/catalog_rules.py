"""Null keys, hard rows, rule tables and unions: queries on what must not get lost."""

from pyspark.sql import functions as F

from annotary.functions import geometry as g
from annotary.functions import scoring
from annotary.operators import masks, sessions, split, taxonomy
from annotary.operators import records as rec
from annotary.operators import scored as m
from annotary.plans import catalog_corpus, sql, standin
from annotary.plans.catalog import query
from annotary.session import scratch_path, sized
from annotary.sources import coco as coco_source
from annotary.sources import images as image_source
from annotary.sources import listing, sinks, supervisely

# -- null keys ---------------------------------------------------------------------


@query("""WITH keyed AS (SELECT event_id, ts, CASE WHEN user_id % 7 > 0 THEN user_id END AS user_key FROM events),
flagged AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 600 SECOND THEN event_id END AS head
  FROM keyed WINDOW w AS (PARTITION BY user_key ORDER BY ts, event_id))
SELECT event_id, user_key, last_value(head IGNORE NULLS) OVER (PARTITION BY user_key ORDER BY ts, event_id) AS session_id
FROM flagged""")
def session_merge_null_key(spark, sf_dir):
    """Events of unknown users share one timeline."""
    events = standin.table(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(F.col("user_id") % 7 > 0, F.col("user_id")).alias("user_key")
    )
    return sessions.merge_sessions(events, "event_id", "ts", ["user_key"], 600).select("event_id", "user_key", "session_id")


_UNGROUPED = sql.COUNTED + """,
ungrouped AS (SELECT * REPLACE (CASE WHEN hash_free % 50 = 0 THEN '' ELSE group_id END AS group_id)
  FROM (SELECT *, CAST(replace(group_id, 'grp/', '') AS BIGINT) AS hash_free FROM counted))"""


@query(f"""WITH {_UNGROUPED}, {sql.split(source="ungrouped")}
SELECT image_id, nullif(group_id, '') AS group_id, split FROM ungrouped JOIN assignment USING (group_id)""")
def group_split_null_group(spark, sf_dir):
    """Images without a group are one group and keep their rows."""
    number = F.substring_index("group_id", "/", -1).cast("long")
    images = standin.counted_images(spark, sf_dir).withColumn("group_id", F.when(number % 50 != 0, F.col("group_id")))
    return split.group_split(images, seed=42).select("image_id", "group_id", "split")


@query("""WITH named AS (
  SELECT event_id, 'g' || user_id AS group_id, CASE WHEN event_id % 6 = 5 THEN NULL
    WHEN event_id % 4 = 0 THEN 'Thumbnail' || (event_id + 1) || '.jpg' ELSE event_id || '.jpg' END AS name
  FROM events)
SELECT n.event_id, CASE WHEN n.name LIKE 'Thumbnail%' THEN coalesce(t.group_id, n.group_id) ELSE n.group_id END AS group_id
FROM named n LEFT JOIN named t ON t.name = substr(n.name, 10) AND n.name LIKE 'Thumbnail%'""")
def thumbnail_null_path(spark, sf_dir):
    """Files without a path are no thumbnails and stay as they are."""
    eid = F.col("event_id")
    name = F.when(eid % 4 == 0, F.concat(F.lit("Thumbnail"), (eid + 1).cast("string"))).otherwise(eid.cast("string"))
    records = standin.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("group_id"),
        F.when(eid % 6 != 5, F.concat(F.lit("/corpus/"), name, F.lit(".jpg"))).alias("file_path"),
    )
    return sessions.link_thumbnails(records, load_order="event_id").select("event_id", "group_id")


# -- hard rows ---------------------------------------------------------------------


@query("""WITH points AS (SELECT vec_id, label, embedding AS e, unnest(range(32)) AS i FROM embeddings),
edges AS (
  SELECT vec_id, label, i,
    CASE i WHEN 0 THEN 1e9::DOUBLE ELSE 24 + 60 * CAST(e[2 * i + 1] AS DOUBLE) END AS x1,
    CASE i WHEN 0 THEN 3e9::DOUBLE WHEN 9 THEN -1e9::DOUBLE ELSE 24 + 60 * CAST(e[2 * i + 2] AS DOUBLE) END AS y1
  FROM points),
closed AS (SELECT *, coalesce(lead(x1) OVER w, first_value(x1) OVER w) AS x2, coalesce(lead(y1) OVER w, first_value(y1) OVER w) AS y2
  FROM edges WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
lines AS (SELECT unnest(range(48)) AS y),
crossings AS (
  SELECT vec_id, label, y, x1 + (y + 0.5::DOUBLE - y1) * (x2 - x1) / (y2 - y1) AS xc
  FROM closed JOIN lines ON (y1 <= y + 0.5::DOUBLE) <> (y2 <= y + 0.5::DOUBLE)),
pixels AS (
  SELECT vec_id, label, y, x FROM crossings, (SELECT unnest(range(48)) AS x)
  GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (xc <= x + 0.5::DOUBLE) % 2 = 1)
SELECT 'vec/' || vec_id AS image_id, label AS class, CAST(y AS INTEGER) AS y, count(*) AS n_pixels,
  CAST(min(x) AS INTEGER) AS first_x, CAST(max(x) AS INTEGER) AS last_x FROM pixels GROUP BY 1, 2, 3""")
def polygon_fill_far(spark, sf_dir):
    """Polygons with two vertices far outside their 48 x 48 frame."""
    far = {0: 1e9, 1: 3e9, 19: -1e9}

    def moved(v, i):
        out = F.lit(24.0) + 60 * v.cast("double")
        for place, value in far.items():
            out = F.when(i == place, F.lit(value)).otherwise(out)
        return out

    polygons = standin.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("image_id"),
        F.col("label").alias("class"),
        F.lit("0").alias("instance_id"),
        F.array(F.transform("embedding", moved)).alias("polygon"),
        F.lit(48).alias("width"),
        F.lit(48).alias("height"),
    )
    return masks.polygon_runs(polygons).groupBy("image_id", "class", "y").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("n_pixels"), F.min("x0").alias("first_x"),
        (F.max("x1") - 1).cast("int").alias("last_x"),
    )


@query("""SELECT vec_id, (label % 5 > 0)::INT + (label % 2)::INT + 1 AS n_rings FROM embeddings""")
def small_rings(spark, sf_dir):
    """Rings of fewer than three points do not count: a vector, a pair of points, part of a vector."""
    size = F.when(F.col("label") % 2 == 1, 6).otherwise(5)
    some = F.when(F.col("label") % 5 > 0, F.slice("e", 1, 8)).otherwise(F.slice("e", 1, 4))
    rings = standin.table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    rings = rings.select("vec_id", F.array(F.col("e"), some, F.slice("e", F.lit(3), size)).alias("polygon"))
    return rings.select("vec_id", F.size(g.readable_rings("polygon")).alias("n_rings"))


_STEEP = """WITH logits AS (SELECT l_partkey % 3 AS target, l_quantity * 40 AS a, l_linenumber * 331.7::DOUBLE AS b, l_discount * 20000.1::DOUBLE AS c FROM lineitem),
terms AS (SELECT target, greatest(a, b, c) + ln(exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c)))
  - CASE target WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS ce,
  exp(CASE target WHEN 0 THEN a WHEN 1 THEN b ELSE c END - greatest(a, b, c)) = 0 AS gone FROM logits)"""


@query(_STEEP + """ SELECT CAST(target AS INTEGER) AS target, count(*) AS n, count(*) FILTER (gone) > 0 AS underflows, round(avg(ce), 4) AS cross_entropy
FROM terms GROUP BY 1""")
def losses_underflow(spark, sf_dir):
    """Logits so far apart that probabilities underflow: no row may leave the loss."""
    lines = standin.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 3).cast("int").alias("target"),
        F.array(F.col("l_quantity") * 40, F.col("l_linenumber") * F.lit(331.7), F.col("l_discount") * F.lit(20000.1)).alias("logits"),
    )
    rows = lines.withColumn("probs", scoring.softmax("logits", 3))
    cube = m.score_cube(rows, 3).groupBy("target").agg(F.sum("n").alias("n"), F.sum("ce_sum").alias("ce"))
    gone = rows.groupBy("target").agg(F.max(F.get("probs", F.col("target")) == 0).alias("underflows"))
    return cube.join(gone, "target").select("target", "n", "underflows", F.round(F.col("ce") / F.col("n"), 4).alias("cross_entropy"))


# -- rule tables -------------------------------------------------------------------


@query("""WITH maps AS (SELECT DISTINCT lang AS source, source AS source_class, CAST(substr(source, 4) AS INTEGER) AS k FROM documents),
entries AS (SELECT *, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Bad-' || k ELSE 'c' || k % 4 END AS canonical,
  CASE WHEN k % 5 = 0 THEN 'exclude' WHEN k % 7 = 0 THEN 'drop' ELSE 'map' END AS decision, CASE WHEN k % 8 = 3 THEN ' ' ELSE 'read so' END AS note FROM maps),
canon AS (SELECT DISTINCT coalesce(canonical, 'c9') AS name FROM entries WHERE k % 2 = 0 OR k % 6 = 1)
SELECT 'name is not snake_case' AS rule, name AS item FROM canon WHERE NOT regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*')
UNION ALL SELECT 'description or group is empty', name FROM canon WHERE name = 'c2'
UNION ALL SELECT 'size is neither large nor fine', name FROM canon WHERE name = 'c0'
UNION ALL SELECT 'unknown decision', source || '/' || source_class FROM entries WHERE decision NOT IN ('map', 'keep_specific', 'exclude')
UNION ALL SELECT 'note is empty', source || '/' || source_class FROM entries WHERE trim(note) = ''
UNION ALL SELECT 'excluded class has a canonical', source || '/' || source_class FROM entries WHERE decision = 'exclude' AND canonical IS NOT NULL
UNION ALL SELECT 'canonical is missing', source || '/' || source_class FROM entries WHERE decision <> 'exclude' AND canonical IS NULL
UNION ALL SELECT 'canonical is unknown', source || '/' || source_class FROM entries WHERE decision <> 'exclude' AND canonical IS NOT NULL AND canonical NOT IN (SELECT name FROM canon)""")
def taxonomy_checks(spark, sf_dir):
    """Every broken rule of a taxonomy made, with faults, from the documents' origins."""
    k = F.substring("source_class", 4, 10).cast("int")
    maps = standin.table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("source").alias("source_class")).distinct()
    kc = k.cast("string")
    entries = maps.select(
        "source", "source_class", k.alias("k"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, F.concat(F.lit("Bad-"), kc)).otherwise(F.concat(F.lit("c"), (k % 4).cast("string"))).alias("canonical"),
        F.when(k % 5 == 0, "exclude").when(k % 7 == 0, "drop").otherwise("map").alias("decision"),
        F.when(k % 8 == 3, " ").otherwise("read so").alias("note"),
    )
    names = entries.filter((F.col("k") % 2 == 0) | (F.col("k") % 6 == 1)).select(F.coalesce("canonical", F.lit("c9")).alias("name")).distinct()
    canonical = names.select(
        "name", F.when(F.col("name") == "c2", "").otherwise("words").alias("description"), F.lit("any").alias("group"),
        F.when(F.col("name") == "c0", "huge").otherwise("fine").alias("size"),
    )
    return taxonomy.taxonomy_violations(canonical, entries.drop("k"))


@query(f"""WITH {sql.COUNTED}, {sql.split()}
SELECT image_id, group_id, split FROM counted JOIN assignment USING (group_id) WHERE split = 'val'""")
def split_selection(spark, sf_dir):
    done = split.group_split(standin.counted_images(spark, sf_dir), seed=42)
    return rec.select_split(done, "val").select("image_id", "group_id", "split")


@query("""SELECT l_orderkey * 1000 + l_linenumber AS id, l_orderkey AS image_id, CAST(l_linenumber AS INTEGER) AS category_id,
  CASE WHEN l_tax = 0.08 THEN 1 ELSE 0 END AS iscrowd FROM lineitem WHERE l_tax = 0.08 OR l_discount = 0.1 OR l_linenumber = 7""")
def rejected_annotations(spark, sf_dir):
    """Crowd, run-length and uncategorised annotations of documents made of orders."""
    ann = F.struct(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").cast("int").alias("category_id"),
        F.when(F.col("l_discount") == 0.1, '{"counts": "a9"}').otherwise("[[0, 0, 5, 0, 5, 5]]").alias("segmentation"),
        F.when(F.col("l_tax") == 0.08, 1).otherwise(0).alias("iscrowd"),
    )
    names = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(f"class {k}").alias("name")) for k in range(1, 7)])
    docs = standin.table(spark, sf_dir, "lineitem").select(F.array(ann).alias("annotations"), names.alias("categories"))
    return coco_source.rejected(coco_source.named_annotations(docs)[0])


@query("""SELECT 'Broken part' AS title UNION ALL SELECT 'Cracked' UNION ALL SELECT 'Flaking'
UNION ALL SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem""")
def class_set_check(spark, sf_dir):
    """Declared titles against the expected ones: those on one side only."""
    kept = [c for c in supervisely.CLASSES if c not in ("Broken part", "Cracked", "Flaking")]
    modes = standin.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("title")).distinct()
    titles = modes.unionByName(spark.createDataFrame([(c,) for c in kept], "title string"))
    path = scratch_path(spark, "meta")
    titles.select(F.array(F.struct("title")).alias("classes")).write.json(path)
    return supervisely.class_set_difference(spark, path, lines=True)


@query("""SELECT '| ' || o_orderpriority || ' | ' || n || ' |' AS line FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
UNION ALL SELECT '| o_orderpriority | n |' UNION ALL SELECT '|---|---|'""")
def markdown_report(spark, sf_dir):
    """A report table written as Markdown and read back."""
    counts = standin.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "markdown")
    sinks.write_markdown(counts, path, ["o_orderpriority"])
    return spark.read.text(path).withColumnRenamed("value", "line")


# -- unions ------------------------------------------------------------------------


@query("""WITH images AS (SELECT 'o/' || o_custkey AS group_id, CASE WHEN o_orderkey % 9 = 0 THEN 'val' ELSE 'train' END AS split FROM orders
UNION ALL SELECT CASE WHEN c_custkey % 4 = 0 THEN 'o/' ELSE 'c/' END || c_custkey, 'train' FROM customer)
SELECT group_id, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(*) AS n_images
FROM images GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def union_leaks(spark, sf_dir):
    """Two corpora put together; groups that now stand in two splits."""
    orders = standin.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o/"), F.col("o_custkey").cast("string")).alias("group_id"),
        F.when(F.col("o_orderkey") % 9 == 0, "val").otherwise("train").alias("split"),
    )
    customers = standin.table(spark, sf_dir, "customer").select(
        F.concat(F.when(F.col("c_custkey") % 4 == 0, "o/").otherwise("c/"), F.col("c_custkey").cast("string")).alias("group_id"),
        F.lit("train").alias("split"),
    )
    return split.find_leaks(orders.unionByName(customers))


@query(f"""WITH {sql.BOXES}
SELECT CASE source_class WHEN 'AF' THEN 'damage_af' WHEN 'NO' THEN 'damage_no' ELSE 'other' END AS canonical, count(*) AS n
FROM boxes WHERE source_class <> 'RF' GROUP BY 1""")
def mapped_by_function(spark, sf_dir):
    """Classes through a Python callable that sees each distinct class once."""
    names = {"AF": "damage_af", "NO": "damage_no", "RF": None}
    lines = standin.instances(spark, sf_dir).select("source_class")
    mapped = taxonomy.map_with(lines, lambda c: names.get(c, "other"))
    return mapped.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {sql.BOXES}
SELECT CASE coalesce(nullif(source_class, 'NO'), 'none') WHEN 'AF' THEN 'damage_af' WHEN 'none' THEN 'unlabelled' ELSE 'other' END AS canonical,
  count(*) AS n
FROM boxes WHERE source_class <> 'RF' GROUP BY 1""")
def mapped_null_class(spark, sf_dir):
    """As ``mapped_by_function``, with rows of no class, which the callable maps as well."""
    names = {"AF": "damage_af", None: "unlabelled", "RF": None}
    lines = standin.instances(spark, sf_dir).select(F.nullif("source_class", F.lit("NO")).alias("source_class"))
    mapped = taxonomy.map_with(lines, lambda c: names.get(c, "other"))
    return mapped.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {sql.IMAGES}, {sql.BOXES},
judged AS (SELECT source = '5-LOW' AS no_source, source_class = 'RO' AS no_class FROM boxes JOIN images USING (image_id))
SELECT 'taxonomy coverage, unknown source' AS rule, count(*) FILTER (no_source) AS n FROM judged
UNION ALL SELECT 'taxonomy coverage, unknown class', count(*) FILTER (no_source OR no_class) FROM judged""")
def coverage_in_flight(spark, sf_dir):
    """Rows of unmapped classes, counted by the job that harmonises the others."""
    entries = catalog_corpus._mapping(spark, catalog_corpus.SOURCES[:-1]).filter(F.col("source_class") != "RO")
    harmonised, watch = taxonomy.harmonise_watched(catalog_corpus._sourced(spark, sf_dir), entries)
    sized(harmonised.groupBy("canonical").count())
    return spark.createDataFrame(list(watch.counts().items()), "rule string, n long")


@query("""SELECT o_orderstatus AS status, CAST(o_custkey % 40 AS INTEGER) AS part, TRUE AS equal FROM orders
WHERE o_orderstatus IS NOT NULL AND o_custkey IS NOT NULL GROUP BY ALL""")
def file_listing(spark, sf_dir):
    """A tree of files written from the orders, listed in tasks and by Spark's own file source."""
    path = scratch_path(spark, "tree")
    orders = standin.table(spark, sf_dir, "orders").filter("o_orderstatus is not null and o_custkey is not null")
    orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 40).cast("int").alias("part")).repartition(
        "status", "part"
    ).write.partitionBy("status", "part").json(path)
    mine = listing.list_tree(spark, path).filter(F.col("path").endswith(".json"))
    theirs = image_source.list_files(spark, path).filter(F.col("path").endswith(".json"))
    both = mine.select("path", F.lit(1).alias("n")).union(theirs.select("path", F.lit(-1).alias("n")))
    folders = both.groupBy(
        F.regexp_extract("path", "/status=([^/]*)/", 1).alias("status"), F.regexp_extract("path", "/part=([^/]*)/", 1).cast("int").alias("part"), "path"
    ).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return folders.groupBy("status", "part").agg(F.bool_and((F.col("n") == 0) & (F.col("k") == 2)).alias("equal"))
