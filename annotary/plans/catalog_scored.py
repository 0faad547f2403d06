"""Confusion, calibration and loss queries over scored rows."""

from pyspark.sql import functions as F

from annotary.functions import scoring
from annotary.operators import scored as m
from annotary.plans import standin
from annotary.plans.catalog import query
from annotary.session import evaluate_once
from annotary.streaming import scored as live
from annotary.streaming.sinks import drain_complete

K = 3

# Three scores per line item; no two can tie, whatever the row.
_SCORED = """logits AS (
  SELECT l_partkey % 3 AS target, l_quantity / 10 AS a, l_linenumber * 0.73::DOUBLE + 0.011::DOUBLE AS b,
         l_discount * 37.3::DOUBLE + 0.0173::DOUBLE AS c FROM lineitem),
exps AS (SELECT target, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b,
                exp(c - greatest(a, b, c)) AS c FROM logits),
scored AS (SELECT CAST(target AS INTEGER) AS target, a / (a + b + c) AS p0, b / (a + b + c) AS p1,
                  c / (a + b + c) AS p2 FROM exps),
labelled AS (SELECT *, greatest(p0, p1, p2) AS conf,
  CASE greatest(p0, p1, p2) WHEN p0 THEN 0 WHEN p1 THEN 1 ELSE 2 END AS pred FROM scored),
confusion AS (
  SELECT t.i AS target, p.i AS pred, count(labelled.target) AS n
  FROM (VALUES (0), (1), (2)) t(i) CROSS JOIN (VALUES (0), (1), (2)) p(i)
  LEFT JOIN labelled ON labelled.target = t.i AND labelled.pred = p.i GROUP BY 1, 2),
marks AS (
  SELECT c AS class, CAST(coalesce(sum(n) FILTER (target = c AND pred = c), 0) AS BIGINT) AS tp,
    CAST(coalesce(sum(n) FILTER (target <> c AND pred = c), 0) AS BIGINT) AS fp,
    CAST(coalesce(sum(n) FILTER (target = c AND pred <> c), 0) AS BIGINT) AS fn
  FROM confusion, (VALUES (0), (1), (2)) k(c) GROUP BY 1),
scores AS (SELECT *, tp / nullif(tp + fp + fn, 0) AS iou, 2 * tp / nullif(2 * tp + fp + fn, 0) AS dice FROM marks),
bins AS (
  SELECT least(CAST(floor(conf * 15) AS INTEGER), 14) AS bin, count(*) AS n, avg(conf) AS mean_confidence,
         avg(CASE WHEN pred = target THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM labelled GROUP BY 1),
terms AS (SELECT *, pow(p0 - (target = 0)::INT, 2) + pow(p1 - (target = 1)::INT, 2) + pow(p2 - (target = 2)::INT, 2) AS sq,
    -ln(CASE target WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS ce FROM labelled),
dice AS (
  SELECT class, (2 * sum(p) FILTER (target = class) + 1e-6::DOUBLE)
    / (sum(p) + count(*) FILTER (target = class) + 1e-6::DOUBLE) AS soft_dice
  FROM (SELECT target, unnest([0, 1, 2]) AS class, unnest([p0, p1, p2]) AS p FROM scored) GROUP BY 1
  HAVING count(*) FILTER (target = class) > 0)"""


def _scored_of(lines):
    logits = F.array(
        F.col("l_quantity") / 10,
        F.col("l_linenumber") * F.lit(0.73) + F.lit(0.011),
        F.col("l_discount") * F.lit(37.3) + F.lit(0.0173),
    )
    return lines.select(
        (F.col("l_partkey") % K).cast("int").alias("target"), scoring.softmax(logits, K).alias("probs")
    )


def scored_lines(spark, sf_dir):
    return _scored_of(standin.table(spark, sf_dir, "lineitem"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS class FROM embeddings),
x AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM e),
p AS (SELECT *, exp(v - top) / sum(exp(v - top)) OVER (PARTITION BY vec_id) AS p FROM x)
SELECT vec_id, CAST(class AS INTEGER) AS class, round(p, 6) AS p,
  CAST(min(class) FILTER (v = top) OVER (PARTITION BY vec_id) AS INTEGER) AS pred FROM p""")
def softmax_scores(spark, sf_dir):
    """Whole vectors as logits."""
    vectors = evaluate_once(standin.table(spark, sf_dir, "embeddings"), probs=scoring.softmax("embedding"))
    rows = vectors.select("vec_id", scoring.argmax("probs").alias("pred"), F.posexplode("probs").alias("class", "p"))
    return rows.select("vec_id", "class", F.round("p", 6).alias("p"), "pred")


@query(f"WITH {_SCORED} SELECT target, pred, n FROM confusion")
def confusion(spark, sf_dir):
    return m.confusion(m.with_prediction(scored_lines(spark, sf_dir)), K)


@query(f"""WITH {_SCORED}
SELECT class, tp, fp, fn, round(iou, 6) AS iou, round(dice, 6) AS dice FROM scores""")
def iou_dice(spark, sf_dir):
    scores = m.class_scores(m.confusion(m.with_prediction(scored_lines(spark, sf_dir)), K))
    return scores.withColumn("iou", F.round("iou", 6)).withColumn("dice", F.round("dice", 6))


@query(f"""WITH {_SCORED}
SELECT round(avg(iou), 6) AS mean_iou, round(coalesce(avg(iou) FILTER (class <> 0), 0), 6) AS mean_iou_damage
FROM scores""")
def mean_iou(spark, sf_dir):
    table = m.confusion(m.with_prediction(scored_lines(spark, sf_dir)), K)
    means = m.mean_iou(m.class_scores(table))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query(f"""WITH {_SCORED}
SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM bins""")
def ece_bins(spark, sf_dir):
    bins = m.reliability_bins(m.score_cube(scored_lines(spark, sf_dir), K))
    return bins.withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query(f"""WITH {_SCORED}
SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM bins""")
def ece(spark, sf_dir):
    bins = m.reliability_bins(m.score_cube(scored_lines(spark, sf_dir), K))
    return m.expected_calibration_error(bins).select(F.round("ece", 6).alias("ece"))


@query(f"WITH {_SCORED} SELECT round(avg(sq), 6) AS brier_score FROM terms")
def brier(spark, sf_dir):
    score = m.brier_score(m.score_cube(scored_lines(spark, sf_dir), K))
    return score.select(F.round("brier_score", 6).alias("brier_score"))


@query(f"""WITH {_SCORED}
SELECT round((SELECT avg(ce) FROM terms), 6) AS cross_entropy, round((SELECT 1 - avg(soft_dice) FROM dice), 6) AS dice_loss,
  round((SELECT avg(ce) FROM terms) + (SELECT 1 - avg(soft_dice) FROM dice), 6) AS loss""")
def losses(spark, sf_dir):
    values = m.losses(m.score_cube(scored_lines(spark, sf_dir), K), K)
    return values.select(*[F.round(c, 6).alias(c) for c in values.columns])


@query(f"""WITH {_SCORED}
SELECT round((SELECT avg(ce) FROM terms), 6) AS cross_entropy,
  round((SELECT 1 - avg(soft_dice) FROM dice), 6) AS dice_loss,
  round((SELECT avg(ce) FROM terms) + (SELECT 1 - avg(soft_dice) FROM dice), 6) AS loss,
  (SELECT round(avg(iou), 6) FROM scores) AS mean_iou,
  (SELECT round(coalesce(avg(iou) FILTER (class <> 0), 0), 6) FROM scores) AS mean_iou_damage,
  {", ".join(f"(SELECT round({x}, 6) FROM scores WHERE class = {c}) AS {x}_{c}" for x in ("iou", "dice") for c in range(3))},
  (SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) FROM bins) AS ece,
  (SELECT round(avg(sq), 6) FROM terms) AS brier_score""")
def evaluation_report(spark, sf_dir):
    report = m.evaluation_report(scored_lines(spark, sf_dir), K)
    return report.select(*[F.round(c, 6).alias(c) for c in report.columns])


@query(f"WITH {_SCORED} SELECT target, pred, n FROM confusion")
def merged_confusion(spark, sf_dir):
    """Two partial tables added: shipped before and since 1999."""
    def part(test):
        lines = standin.table(spark, sf_dir, "lineitem").filter(test)
        return m.confusion(m.with_prediction(_scored_of(lines)), K)

    recent = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    recent = F.coalesce(recent, F.lit(False))  # lines without a date belong to the first part
    return m.merge_confusions(part(recent), part(~recent))


@query(f"WITH {_SCORED} SELECT target, pred, n FROM confusion")
def stream_confusion(spark, sf_dir):
    """The running confusion table of a stream that has caught up."""
    stream = standin.landed(spark, sf_dir, "lineitem")
    counts = drain_complete(live.running_confusion(_scored_of(stream), K), "confusion")
    return m.complete_grid(counts, K)


@query(f"""WITH {_SCORED}
SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM bins""")
def stream_reliability(spark, sf_dir):
    """Reliability bins from the streamed score cube."""
    stream = standin.landed(spark, sf_dir, "lineitem")
    bins = m.reliability_bins(drain_complete(live.running_cube(_scored_of(stream), K), "cube"))
    return bins.withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn(
        "accuracy", F.round("accuracy", 6)
    )
