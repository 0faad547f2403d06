"""Metrics over scored rows: confusion, IoU, Dice, calibration, losses.

A scored row has ``target`` and ``probs`` (or ``pred`` for plain labels). All
metrics derive from one small cube, counts and sums per (target, prediction,
confidence bin), so a full report is one scan and one shuffle of at most
K x K x bins rows per task. Cubes add up: the cube of a union is the sum of
the cubes, in batch as in streaming. Undefined values are NULL.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.checks import CorpusError
from annotary.functions import scoring

# Calibration bins and the weights of the combined loss.
N_BINS = 15
DICE_EPS = 1e-6


def with_prediction(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pred", scoring.argmax("probs"))


def _checked(col, n_classes):
    """The column itself, or an error naming the class outside 0..K-1."""
    c = F.col(col)
    return F.when((c >= 0) & (c < n_classes), c).otherwise(
        F.raise_error(
            F.concat(F.lit(f"{col} out of range for K={n_classes}: "), c.cast("string"))
        ).cast("int")
    )


def confusion(labelled: DataFrame, n_classes: int) -> DataFrame:
    """Full K x K grid ``(target, pred, n)``; row = truth, column = prediction."""
    return complete_grid(confusion_counts(labelled, n_classes), n_classes)


def confusion_counts(labelled: DataFrame, n_classes: int) -> DataFrame:
    """Non-zero cells only; also the form a stream keeps as state.

    Labels are checked once per cell, after counting, not once per row.
    """
    counts = labelled.groupBy(
        F.col("target").cast("int").alias("target"), F.col("pred").cast("int").alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        _checked("target", n_classes).alias("target"), _checked("pred", n_classes).alias("pred"), "n"
    )


def complete_grid(counts: DataFrame, n_classes: int) -> DataFrame:
    """Absent cells of a confusion table as zeros (K x K rows in all)."""
    cells = counts.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).cast("int").alias("target"),
        (F.col("id") % n_classes).cast("int").alias("pred"),
        F.lit(0).cast("long").alias("n"),
    )
    return cells.unionByName(counts).groupBy("target", "pred").agg(F.sum("n").alias("n"))


def class_scores(confusion_table: DataFrame) -> DataFrame:
    """Per class TP, FP, FN, IoU and Dice; NULL where nothing was seen."""
    sides = confusion_table.select(
        F.explode(
            F.array(
                F.struct(F.col("target").alias("class"), F.lit(True).alias("truth")),
                F.struct(F.col("pred").alias("class"), F.lit(False).alias("truth")),
            )
        ).alias("side"),
        "target",
        "pred",
        "n",
    )
    hit = F.col("target") == F.col("pred")
    per_class = sides.groupBy(F.col("side.class").alias("class")).agg(
        F.coalesce(F.sum(F.when(hit & F.col("side.truth"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~hit & ~F.col("side.truth"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit & F.col("side.truth"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    tp = F.col("tp").cast("double")
    miss = F.col("fp") + F.col("fn")
    return per_class.withColumn("iou", F.try_divide(tp, tp + miss)).withColumn(
        "dice", F.try_divide(2 * tp, 2 * tp + miss)
    )


def mean_iou(scores: DataFrame) -> DataFrame:
    """Mean over defined classes, and the damage mean (no class 0, else 0.0)."""
    return scores.agg(
        F.avg("iou").alias("mean_iou"),
        F.coalesce(F.avg(F.when(F.col("class") != 0, F.col("iou"))), F.lit(0.0)).alias(
            "mean_iou_damage"
        ),
    )


def score_cube(scored: DataFrame, n_classes: int, n_bins: int = N_BINS) -> DataFrame:
    """Counts and sums per (target, pred, bin): all the metrics' raw material.

    The loss of a row comes from its ``logits`` if there are any, else from
    ``probs``, bounded as ``scoring.cross_entropy`` says.
    """
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    exact = "logits" in scored.columns
    loss = scoring.logit_cross_entropy("logits", "target", n_classes) if exact else scoring.cross_entropy("probs", "target")
    rows = (
        with_prediction(scored)
        .select(
            F.col("target").cast("int").alias("target"),
            "pred",
            "probs",
            scoring.confidence("probs").alias("conf"),
            loss.alias("ce"),
        )
        .withColumn("bin", scoring.confidence_bin("conf", n_bins))
    )
    cube = rows.groupBy("target", "pred", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("conf").alias("conf_sum"),
        F.sum(scoring.squared_error("probs", "target", n_classes)).alias("brier_sum"),
        F.sum("ce").alias("ce_sum"),
        *[F.sum(F.get("probs", c)).alias(f"p{c}") for c in range(n_classes)],
    )
    return cube.withColumn("target", _checked("target", n_classes))


def cube_confusion(cube: DataFrame, n_classes: int) -> DataFrame:
    return complete_grid(cube.groupBy("target", "pred").agg(F.sum("n").alias("n")), n_classes)


def reliability_bins(cube: DataFrame) -> DataFrame:
    """Per non-empty bin: rows, mean confidence, accuracy."""
    hits = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    return cube.groupBy("bin").agg(
        F.sum("n").alias("n"),
        (F.sum("conf_sum") / F.sum("n")).alias("mean_confidence"),
        (F.sum(hits) / F.sum("n")).alias("accuracy"),
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """Population-weighted gap of accuracy and confidence; NULL when empty."""
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.agg(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"))


def brier_score(cube: DataFrame) -> DataFrame:
    return cube.agg(F.try_divide(F.sum("brier_sum"), F.sum("n")).alias("brier_score"))


def soft_dice(cube: DataFrame, n_classes: int, eps: float = DICE_EPS) -> DataFrame:
    """Per class present in the truth the soft Dice of all rows together."""
    per_target = cube.groupBy("target").agg(
        F.sum("n").alias("n"), *[F.sum(f"p{c}").alias(f"p{c}") for c in range(n_classes)]
    )
    everything = Window.partitionBy()  # K rows
    p_total = F.array(*[F.sum(f"p{c}").over(everything) for c in range(n_classes)])
    own = F.array(*[F.col(f"p{c}") for c in range(n_classes)])
    inter = F.get(own, F.col("target"))
    return per_target.select(
        F.col("target").alias("class"),
        ((2 * inter + eps) / (F.get(p_total, F.col("target")) + F.col("n") + eps)).alias("soft_dice"),
    )


def losses(cube: DataFrame, n_classes: int, ce_weight=1.0, dice_weight=1.0, eps=DICE_EPS):
    """Mean cross-entropy, soft-Dice loss and their weighted sum, over all rows.

    One row-weighted value for the whole table, not a mean of batch means.
    """
    ce = cube.agg(F.try_divide(F.sum("ce_sum"), F.sum("n")).alias("cross_entropy"))
    dice = soft_dice(cube, n_classes, eps).agg(
        F.coalesce(1 - F.avg("soft_dice"), F.lit(0.0)).alias("dice_loss")
    )
    return _side_by_side(ce, dice).withColumn(
        "loss", ce_weight * F.col("cross_entropy") + dice_weight * F.col("dice_loss")
    )


def evaluation_report(scored: DataFrame, n_classes: int, n_bins: int = N_BINS) -> DataFrame:
    """One row: loss, mean IoUs, IoU and Dice per class, ECE, Brier.

    One pass over the rows; the rest works on the pinned cube.
    """
    from annotary.session import pinned

    cube = pinned(score_cube(scored, n_classes, n_bins))
    scores = class_scores(cube_confusion(cube, n_classes))
    per_class = scores.groupBy().agg(
        *[
            F.max(F.when(F.col("class") == c, F.col(metric))).alias(f"{metric}_{c}")
            for metric in ("iou", "dice")
            for c in range(n_classes)
        ]
    )
    return _side_by_side(
        losses(cube, n_classes),
        mean_iou(scores),
        per_class,
        expected_calibration_error(reliability_bins(cube)),
        brier_score(cube),
    )


def _side_by_side(*one_row_frames) -> DataFrame:
    """Join frames of exactly one row each on a constant key."""
    out = None
    for frame in one_row_frames:
        keyed = frame.withColumn("_one", F.lit(1))
        out = keyed if out is None else out.join(F.broadcast(keyed), "_one")
    return out.drop("_one")


def merge_confusions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Add two partial confusion tables of the same class count."""
    if left.columns != right.columns:
        raise CorpusError("confusion tables differ in columns")
    return left.unionByName(right).groupBy("target", "pred").agg(F.sum("n").alias("n"))
