"""Mask, component, matching and average-precision queries."""

from pyspark.sql import functions as F

from annotary.functions import scoring
from annotary.operators import instances as inst
from annotary.operators import masks
from annotary.operators import records
from annotary.plans import sql, standin
from annotary.plans.catalog import query
from annotary.session import sized

N_CLASSES = 4

# Eight neighbouring orders share one small image. Open lines predict, closed
# lines are the truth; every line is a rectangle.
_RECTS = """rects AS (
  SELECT 'set/' || (l_orderkey // 8) AS image_id,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS class,
    lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-'
      || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')
      || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS id,
    l_linestatus = 'O' AS predicted, 0.5::DOUBLE + l_discount AS score,
    CAST(l_partkey % 24 AS INTEGER) AS x0, CAST(l_partkey % 24 + 4 + l_quantity % 8 AS INTEGER) AS x1,
    CAST(l_suppkey % 16 AS INTEGER) AS y0, CAST(l_suppkey % 16 + 3 + l_linenumber AS INTEGER) AS y1
  FROM lineitem)"""

_PAIRS = f"""{_RECTS},
touching AS (
  SELECT image_id, class, p.id AS pred_id, t.id AS true_id, p.score,
    (least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS intersection,
    (p.x1 - p.x0) * (p.y1 - p.y0) AS pred_area, (t.x1 - t.x0) * (t.y1 - t.y0) AS true_area
  FROM rects p JOIN rects t USING (image_id, class)
  WHERE p.predicted AND NOT t.predicted AND least(p.x1, t.x1) > greatest(p.x0, t.x0)
    AND least(p.y1, t.y1) > greatest(p.y0, t.y0)),
pairs AS (SELECT *, intersection / (pred_area + true_area - intersection) AS iou FROM touching)"""

# Greedy matching as a walk over each group's edges in sorted order.
_MATCHES = f"""{_PAIRS},
levels AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS DOUBLE) AS threshold),
edges AS (
  SELECT image_id, class, threshold, pred_id, true_id,
    row_number() OVER (PARTITION BY image_id, class, threshold ORDER BY score DESC, pred_id, iou DESC, true_id) AS k
  FROM pairs JOIN levels ON iou >= threshold),
walk AS (
  SELECT image_id, class, threshold, k, [pred_id] AS preds, [true_id] AS truths, pred_id, TRUE AS taken
  FROM edges WHERE k = 1
  UNION ALL
  SELECT w.image_id, w.class, w.threshold, e.k,
    CASE WHEN list_contains(preds, e.pred_id) OR list_contains(truths, e.true_id) THEN preds ELSE list_append(preds, e.pred_id) END,
    CASE WHEN list_contains(preds, e.pred_id) OR list_contains(truths, e.true_id) THEN truths ELSE list_append(truths, e.true_id) END,
    e.pred_id, NOT (list_contains(preds, e.pred_id) OR list_contains(truths, e.true_id))
  FROM walk w JOIN edges e ON e.image_id = w.image_id AND e.class = w.class AND e.threshold = w.threshold AND e.k = w.k + 1),
hits AS (SELECT image_id, class, threshold, pred_id FROM walk WHERE taken),
matches AS (
  SELECT r.image_id, r.class, r.id AS pred_id, r.score, l.threshold, h.pred_id IS NOT NULL AS is_tp
  FROM rects r CROSS JOIN levels l LEFT JOIN hits h
    ON h.image_id = r.image_id AND h.class = r.class AND h.pred_id = r.id AND h.threshold = l.threshold
  WHERE r.predicted)"""

_AP = f"""{_MATCHES},
ranked AS (
  SELECT class, threshold, is_tp, row_number() OVER w AS rank, sum(is_tp::INT) OVER w AS tp FROM matches
  WINDOW w AS (PARTITION BY class, threshold ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING)),
n_truth AS (SELECT class, count(*) AS n_truth FROM rects WHERE NOT predicted GROUP BY 1),
curve AS (SELECT class, threshold, is_tp, rank, tp / rank AS precision, tp / n_truth AS recall
          FROM ranked JOIN n_truth USING (class)),
ap AS (
  SELECT n.class, l.threshold, any_value(n_truth) AS n_truth,
    (SELECT sum(best) / 101 FROM (
       SELECT coalesce(max(precision), 0) AS best
       FROM (SELECT unnest(range(101)) / 100 AS r) g
       LEFT JOIN curve c ON c.class = n.class AND c.threshold = l.threshold AND c.recall >= r GROUP BY r)) AS ap
  FROM n_truth n CROSS JOIN levels l GROUP BY 1, 2)"""


def _lines(spark, sf_dir):
    """The rectangles under numbers instead of names, see ``_image_name`` and ``_name``."""
    flag = F.col("l_returnflag")
    x0, y0 = F.col("l_partkey") % 24, F.col("l_suppkey") % 16
    return standin.table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8).alias("image_id"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("class"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        ).alias("instance_id"),
        (F.col("l_linestatus") == "O").alias("predicted"),
        (F.col("l_discount") + F.lit(0.5)).alias("score"),
        x0.cast("int").alias("x0"),
        (x0 + 4 + F.col("l_quantity") % 8).cast("int").alias("x1"),
        y0.cast("int").alias("y0"),
        (y0 + 3 + F.col("l_linenumber")).cast("int").alias("y1"),
    )


def _image_name():
    return F.concat(F.lit("set/"), F.col("image_id").cast("string"))


def _name(column):
    part = lambda c: F.col(f"{column}.{c}").cast("string")
    pad = lambda c: F.lpad(part(c), 12, "0")
    return F.concat_ws("-", pad("l_orderkey"), part("l_linenumber"), pad("l_partkey"), pad("l_suppkey"), part("cents"))


def _rects(spark, sf_dir):
    return _lines(spark, sf_dir).withColumns({"image_id": _image_name(), "instance_id": _name("instance_id")})


def _runs(rects):
    return rects.select(
        "image_id", "class", "instance_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1"
    )


def _both(spark, sf_dir):
    rects = _rects(spark, sf_dir)
    return rects.filter("predicted"), rects.filter("NOT predicted")


def _mask_rows(rects):
    spans = F.transform(
        F.sequence("y0", F.col("y1") - 1), lambda y: F.struct(y.alias("y"), F.col("x0").alias("x0"), F.col("x1").alias("x1"))
    )
    return rects.select("image_id", "class", "instance_id", "score", spans.alias("spans"))


def _pairs(spark, sf_dir, scored=True):
    """Pairs of masks; they meet under numbers, names are made afterwards."""
    lines = _lines(spark, sf_dir)
    p, t = (_mask_rows(lines.filter(side)) for side in ("predicted", "NOT predicted"))
    return inst.overlapping_masks(p if scored else p.drop("score"), t).withColumns(
        {"image_id": _image_name(), "pred_id": _name("pred_id"), "true_id": _name("true_id")}
    )


def _predictions(spark, sf_dir):
    return _both(spark, sf_dir)[0].select(
        "image_id", "class", F.col("instance_id").alias("pred_id"), "score"
    )


def _matched(spark, sf_dir):
    return inst.greedy_matches(_predictions(spark, sf_dir), _pairs(spark, sf_dir))


def _ap(spark, sf_dir):
    truths = _both(spark, sf_dir)[1]
    return inst.average_precision(sized(_matched(spark, sf_dir)), truths, N_CLASSES)


@query(f"""WITH {_PAIRS}
SELECT image_id, class, pred_id, true_id, CAST(intersection AS BIGINT) AS intersection,
  CAST(pred_area AS BIGINT) AS pred_area, CAST(true_area AS BIGINT) AS true_area, round(iou, 6) AS iou FROM pairs""")
def pair_iou(spark, sf_dir):
    return _pairs(spark, sf_dir, scored=False).withColumn("iou", F.round("iou", 6))


@query(f"""WITH RECURSIVE {_MATCHES}
SELECT image_id, class, pred_id, score, threshold, is_tp FROM matches""")
def greedy_match(spark, sf_dir):
    return inst.match_table(_matched(spark, sf_dir))


@query(f"""WITH RECURSIVE {_MATCHES}
SELECT image_id, class, pred_id, score, threshold, is_tp FROM matches""")
def greedy_match_rounds(spark, sf_dir):
    """The same by rounds over the whole cluster."""
    return inst.match_table(inst.greedy_matches_in_rounds(_predictions(spark, sf_dir), _pairs(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_AP}
SELECT class, threshold, rank, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM curve WHERE is_tp""")
def precision_recall(spark, sf_dir):
    truths = _both(spark, sf_dir)[1]
    curve = inst.precision_recall(sized(_matched(spark, sf_dir)), truths)
    return curve.withColumn("precision", F.round("precision", 6)).withColumn(
        "recall", F.round("recall", 6)
    )


@query(f"WITH RECURSIVE {_AP} SELECT class, threshold, n_truth, round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf_dir):
    return _ap(spark, sf_dir).withColumn("ap", F.round("ap", 6))


@query(f"""WITH RECURSIVE {_AP},
per AS (SELECT threshold, avg(ap) AS map FROM ap GROUP BY 1)
SELECT round(max(map) FILTER (threshold = 0.5), 6) AS map_50, round(avg(map), 6) AS map FROM per""")
def mean_average_precision(spark, sf_dir):
    table = inst.mean_average_precision(_ap(spark, sf_dir))
    return table.select(*[F.round(c, 6).alias(c) for c in table.columns])


@query(f"WITH {sql.COUNTED} SELECT image_id, n_instances FROM counted")
def instance_counts(spark, sf_dir):
    return records.with_instance_counts(
        standin.images(spark, sf_dir).select("image_id"), standin.instances(spark, sf_dir)
    )


# -- fill, merge, letterbox ----------------------------------------------------------


@query("""WITH edges AS (
  SELECT vec_id, label, i,
    24 + 60 * CAST(e[2 * i + 1] AS DOUBLE) AS x1, 24 + 60 * CAST(e[2 * i + 2] AS DOUBLE) AS y1,
    24 + 60 * CAST(e[2 * ((i + 1) % 32) + 1] AS DOUBLE) AS x2, 24 + 60 * CAST(e[2 * ((i + 1) % 32) + 2] AS DOUBLE) AS y2
  FROM (SELECT vec_id, label, embedding AS e, unnest(range(32)) AS i FROM embeddings)),
lines AS (SELECT unnest(range(48)) AS y),
crossings AS (
  SELECT vec_id, label, y, x1 + (y + 0.5::DOUBLE - y1) * (x2 - x1) / (y2 - y1) AS xc
  FROM edges JOIN lines ON (y1 <= y + 0.5::DOUBLE) <> (y2 <= y + 0.5::DOUBLE)),
pixels AS (
  SELECT vec_id, label, y, x FROM crossings, (SELECT unnest(range(48)) AS x)
  GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (xc <= x + 0.5::DOUBLE) % 2 = 1)
SELECT 'vec/' || vec_id AS image_id, label AS class, CAST(y AS INTEGER) AS y, count(*) AS n_pixels,
  CAST(min(x) AS INTEGER) AS first_x, CAST(max(x) AS INTEGER) AS last_x FROM pixels GROUP BY 1, 2, 3""")
def polygon_fill(spark, sf_dir):
    """Vectors as self-crossing 32-point polygons in a 48 x 48 frame."""
    polygons = standin.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("image_id"),
        F.col("label").alias("class"),
        F.lit("0").alias("instance_id"),
        F.array(F.transform("embedding", lambda v: F.lit(24.0) + 60 * v.cast("double"))).alias("polygon"),
        F.lit(48).alias("width"),
        F.lit(48).alias("height"),
    )
    return masks.polygon_runs(polygons).groupBy("image_id", "class", "y").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("n_pixels"),
        F.min("x0").alias("first_x"),
        (F.max("x1") - 1).cast("int").alias("last_x"),
    )


@query(f"""WITH {_RECTS},
pixels AS (SELECT image_id, y, x, arg_max(class, (class, id)) AS class FROM (
    SELECT image_id, class, id, y, unnest(range(x0, x1)) AS x FROM (
      SELECT *, unnest(range(y0, y1)) AS y FROM rects)) GROUP BY 1, 2, 3),
starts AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, class, y ORDER BY x) AS island FROM pixels)
SELECT image_id, class, CAST(y AS INTEGER) AS y, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) + 1 AS INTEGER) AS x1
FROM starts GROUP BY image_id, class, y, island""")
def mask_merge(spark, sf_dir):
    """All rectangles of an image in one mask; the higher class id wins."""
    runs = _runs(_rects(spark, sf_dir)).withColumn("category_id", F.col("class"))
    return masks.merge_masks(runs).select("image_id", "class", "y", "x0", "x1")


_SIZED = """sized AS (SELECT *, 40 + CAST(replace(image_id, 'set/', '') AS BIGINT) % 30 AS width,
  30 + CAST(replace(image_id, 'set/', '') AS BIGINT) % 17 AS height FROM rects),
scaled AS (SELECT *, least(32::DOUBLE / width, 32::DOUBLE / height) AS scale FROM sized),
boxed AS (SELECT *, greatest(1, round_even(width * scale, 0)::INTEGER) AS nw,
                 greatest(1, round_even(height * scale, 0)::INTEGER) AS nh FROM scaled),
seen AS (SELECT image_id, class, id,
    [d FOR d IN range(nw) IF ((2 * d + 1) * width) // (2 * nw) >= x0 AND ((2 * d + 1) * width) // (2 * nw) < x1] AS xs,
    [d FOR d IN range(nh) IF ((2 * d + 1) * height) // (2 * nh) >= y0 AND ((2 * d + 1) * height) // (2 * nh) < y1] AS ys,
    (32 - nw) // 2 AS pad_left, (32 - nh) // 2 AS pad_top FROM boxed)"""


@query(f"""WITH {_RECTS}, {_SIZED}
SELECT image_id, class, id AS instance_id, CAST(len(xs) * len(ys) AS BIGINT) AS area,
  CAST(list_min(xs) + pad_left AS INTEGER) AS x0, CAST(list_min(ys) + pad_top AS INTEGER) AS y0
FROM seen WHERE len(xs) > 0 AND len(ys) > 0""")
def letterbox_masks(spark, sf_dir):
    """Instance masks on a 32 x 32 canvas, against pixel-wise resizing."""
    number = F.substring_index("image_id", "/", -1).cast("long")
    runs = (
        _runs(_rects(spark, sf_dir))
        .withColumn("width", number % 30 + 40)
        .withColumn("height", number % 17 + 30)
    )
    boxed = masks.letterbox_runs(runs, 32)
    return boxed.groupBy("image_id", "class", "instance_id").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0")
    )


# -- components ----------------------------------------------------------------------

_CELLS = """cells AS (
  SELECT DISTINCT 'sup/' || l_suppkey AS image_id,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS class,
    CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x FROM lineitem)"""


def _reach(cells):
    """Recursive CTE: every pixel with every pixel it can be reached from."""
    return f"""
near AS (SELECT a.image_id, a.class, a.y, a.x, b.y AS y2, b.x AS x2
  FROM {cells} a JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON TRUE JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON TRUE
  JOIN {cells} b ON b.image_id = a.image_id AND b.class = a.class AND b.y = a.y + dy AND b.x = a.x + dx),
reach AS (
  SELECT image_id, class, y, x, CAST(y AS BIGINT) * 2147483648 + x AS origin FROM {cells}
  UNION
  SELECT n.image_id, n.class, n.y2, n.x2, r.origin FROM reach r JOIN near n
    ON n.image_id = r.image_id AND n.class = r.class AND n.y = r.y AND n.x = r.x),
labelled AS (SELECT image_id, class, y, x, min(origin) AS component FROM reach GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH RECURSIVE {_CELLS}, {_reach("cells")}
SELECT image_id, class, y, x, component FROM labelled""")
def components(spark, sf_dir):
    """Sparse pixels per supplier; small tiles, so that labels meet at borders."""
    flag = F.col("l_returnflag")
    cells = (
        standin.table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("sup/"), F.col("l_suppkey").cast("string")).alias("image_id"),
            F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("class"),
            (F.col("l_orderkey") % 64).cast("int").alias("y"),
            (F.col("l_partkey") % 64).cast("int").alias("x0"),
        )
        .distinct()
        .withColumn("x1", F.col("x0") + 1)
    )
    return masks.components(cells, tile=32).select(
        "image_id", "class", "y", F.col("x0").alias("x"), "component"
    )


_PIXELS = """logits AS (
  SELECT 'sup/' || l_suppkey AS image_id, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x,
    avg(l_quantity / 10) AS a, avg(l_linenumber * 0.73::DOUBLE + 0.011::DOUBLE) AS b,
    avg(l_discount * 37.3::DOUBLE + 0.0173::DOUBLE) AS c FROM lineitem GROUP BY 1, 2, 3),
cells AS (SELECT image_id, y, x, CASE greatest(a, b, c) WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END AS class,
  1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) AS p FROM logits),
positive AS (SELECT * FROM cells WHERE class > 0)"""


@query(f"""WITH RECURSIVE {_PIXELS}, {_reach("positive")}
SELECT image_id, class, component, count(*) AS n_pixels, round(avg(p), 6) AS score
FROM labelled JOIN positive USING (image_id, class, y, x) GROUP BY 1, 2, 3""")
def predicted_instances(spark, sf_dir):
    """Components of the argmax mask per supplier, with their mean probability."""
    logits = (
        standin.table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("sup/"), F.col("l_suppkey").cast("string")).alias("image_id"),
            (F.col("l_orderkey") % 64).cast("int").alias("y"),
            (F.col("l_partkey") % 64).cast("int").alias("x"),
        )
        .agg(
            F.array(
                F.avg(F.col("l_quantity") / 10),
                F.avg(F.col("l_linenumber") * F.lit(0.73) + F.lit(0.011)),
                F.avg(F.col("l_discount") * F.lit(37.3) + F.lit(0.0173)),
            ).alias("logits")
        )
    )
    scores, _ = masks.predicted_instances(
        logits.select("image_id", "y", "x", scoring.softmax("logits", 3).alias("probs")), tile=32
    )
    return scores.select(
        "image_id", "class", F.col("instance_id").cast("long").alias("component"), "n_pixels",
        F.round("score", 6).alias("score"),
    )
