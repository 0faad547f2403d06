"""Instance-level evaluation: pair IoU, greedy matching, average precision."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.operators.ordered import running_totals
from annotary.session import evaluate_once, scratch_path, sized

# IoU thresholds and recall levels of the averaged metric.
IOU_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
RECALL_STEPS = 100

CELL = 64
_RUNS = 1 << 18
#: Lowest bits of the parts of a shape; places in a cell have six bits each, the area the rest.
_RIGHT, _LEFT, _TOP, _AREA = 1, 7, 13, 19
_FILTER = 24
_KEY = ["image_id", "class"]


def mask_rows(runs: DataFrame) -> DataFrame:
    """One row a mask, its runs as ``spans``."""
    return runs.groupBy(*_KEY, "instance_id").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("spans"))


def _several_cells(cell):
    """Whether a mask lies in more than one cell."""
    spread = lambda low, high: F.floor(low / cell) != F.floor(high / cell)
    side = lambda pick: F.transform("spans", pick)
    return spread(F.array_min(side(lambda s: s["y"])), F.array_max(side(lambda s: s["y"]))) | spread(
        F.array_min(side(lambda s: s["x0"])), F.array_max(side(lambda s: s["x1"])) - 1
    )


def _cut(batch, cell):
    """The masks of ``batch`` in cells, as columns of one row a mask and cell."""
    spans = batch.column("spans")
    flat = spans.flatten()
    y, x0, x1 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x0", "x1"))
    owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    area = np.zeros(len(spans), np.int64)
    np.add.at(area, owner, x1 - x0)
    first, n = x0 // cell, np.where(x1 > x0, (x1 - 1) // cell - x0 // cell + 1, 0)
    run = np.repeat(np.arange(len(y)), n)
    column = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((y[run], column, y[run] // cell, owner[run]))
    run, column = run[order], column[order]
    left, right = np.maximum(x0[run] - column * cell, 0), np.minimum(x1[run] - column * cell, cell)
    bits = (~np.uint64(0) >> (64 - (right - left)).astype(np.uint64)) << left.astype(np.uint64)
    y, owner = y[run], owner[run]
    key = np.stack([owner, y // cell, column])
    begins = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
    begins = np.concatenate([[0], begins]) if len(run) else begins
    size = np.diff(np.append(begins, len(run)))
    top, bottom = y[begins], y[begins + size - 1]
    offsets = np.concatenate([[0], np.cumsum(bottom - top + 1)])
    words = np.zeros(offsets[-1], np.uint64)
    np.bitwise_or.at(words, np.repeat(offsets[:-1] - top, size) + y, bits)
    masks = owner[begins]
    low = np.minimum.reduceat(left, begins) if len(begins) else left
    high = (np.maximum.reduceat(right, begins) if len(begins) else right) - 1
    return {
        **{c: batch.column(c).take(pa.array(masks)) for c in batch.schema.names if c != "spans"},
        "cell": pa.array((top // cell << 32) + column[begins]),
        "shape": pa.array(
            area[masks] << _AREA | top % cell << _TOP | low << _LEFT | high << _RIGHT
            | (np.bincount(masks, minlength=len(spans))[masks] > 1)
        ),
        "words": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words.view(np.int64))),
    }


def _in_cells(masks: DataFrame, cell: int) -> DataFrame:
    """Masks cut into cells of ``cell`` x ``cell`` pixels: a word of bits a row.

    ``shape`` holds what else is to be known of a mask in one number, so that
    little is moved: its whole area, the first row, the first and last column
    in the cell, and whether it lies in several cells.
    """
    kept = masks.select(*_KEY, "instance_id", *[c for c in ("score",) if c in masks.columns], "spans")
    schema = T.StructType(
        kept.drop("spans").schema.fields
        + T._parse_datatype_string("cell long, shape long, words array<long>").fields
    )

    def cut(batches):
        for batch in batches:
            ends = np.cumsum(batch.column("spans").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):  # masks of many runs in smaller parts
                done = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, done + _RUNS, "right")))
                yield pa.RecordBatch.from_pydict(_cut(batch.slice(at, end - at), cell))
                at = end

    return kept.mapInArrow(cut, schema)


def mask_areas(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*_KEY, "instance_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


def overlapping_pairs(predicted: DataFrame, truth: DataFrame, cell: int = CELL) -> DataFrame:
    """IoU of every predicted and true mask that share a pixel, from their runs; see ``overlapping_masks``."""
    return overlapping_masks(mask_rows(predicted), mask_rows(truth), cell)


def overlapping_masks(predicted: DataFrame, truth: DataFrame, cell: int = CELL) -> DataFrame:
    """IoU of every predicted and true mask that share a pixel.

    Masks come as rows with ``spans`` (y, x0, x1), so that only masks, not
    runs, are moved. They meet on (image, class, cell), a cell being at most
    64 pixels wide and high: a crowded image spreads over its cells, and a
    pair's shared pixels are counted in words of bits. Only pairs of which
    both masks lie in several cells are summed over cells. A ``score`` of the
    predictions stays with the pairs.
    """
    cell = min(cell, CELL)
    score = [c for c in ("score",) if c in predicted.columns]
    several = _several_cells(cell)
    at = lambda side, low: F.shiftright(f"{side}_shape", low).bitwiseAND(F.lit(63)).cast("int")
    p_top, t_top = at("p", _TOP), at("t", _TOP)
    above = F.greatest(p_top, t_top)
    shared = F.zip_with(
        F.slice("p_words", above - p_top + 1, F.size("p_words")),
        F.slice("t_words", above - t_top + 1, F.size("t_words")),
        lambda a, b: F.coalesce(F.bit_count(a.bitwiseAND(b)), F.lit(0)),
    )

    def met(predicted, truth):
        sides = []
        for masks, side, name, more in ((predicted, "p", "pred", score), (truth, "t", "true", [])):
            sides.append(
                _in_cells(masks, cell).select(
                    *_KEY, "cell", F.col("instance_id").alias(f"{name}_id"), *more,
                    *[F.col(c).alias(f"{side}_{c}") for c in ("shape", "words")],
                )
            )
        near = (
            (p_top < t_top + F.size("t_words"))
            & (t_top < p_top + F.size("p_words"))
            & (at("p", _LEFT) <= at("t", _RIGHT))
            & (at("t", _LEFT) <= at("p", _RIGHT))
        )
        counted = F.aggregate(shared, F.lit(0).cast("long"), lambda a, n: a + n)
        both = evaluate_once(sides[0].join(sides[1], [*_KEY, "cell"]).filter(near), intersection=counted).filter("intersection > 0")
        sizes = [F.shiftright(f"{side}_shape", _AREA).alias(f"{name}_area") for side, name in (("p", "pred"), ("t", "true"))]
        return both.select("*", *sizes)

    names = [*_KEY, "pred_id", "true_id", "pred_area", "true_area", *score]
    whole = met(predicted, truth).filter("(p_shape & t_shape & 1) = 0").select(*names, "intersection")
    parts = met(predicted.filter(several), truth.filter(several))
    summed = parts.groupBy(*names).agg(F.sum("intersection").alias("intersection"))
    union = F.col("pred_area") + F.col("true_area") - F.col("intersection")
    return (
        whole.unionByName(summed)
        .withColumn("iou", F.col("intersection") / union)
        .select(*_KEY, "pred_id", "true_id", "intersection", "pred_area", "true_area", "iou", *score)
    )


def iou_of_pairs(pairs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """IoU for given pairs; masks that do not meet, or are empty, give 0.0."""
    found = overlapping_pairs(predicted, truth).select(*_KEY, "pred_id", "true_id", "iou")
    return pairs.join(found, [*_KEY, "pred_id", "true_id"], "left").withColumn(
        "iou", F.coalesce("iou", F.lit(0.0))
    )


def greedy_matches(predictions: DataFrame, pairs: DataFrame, thresholds=IOU_THRESHOLDS) -> DataFrame:
    """Predictions with ``hit_thresholds``, those at which they are true positives.

    Per image, class and threshold, predictions by falling score (then id)
    each take the free truth of highest IoU (then smallest id) if that reaches
    the threshold. A pair below the threshold can never be taken, so only
    pairs at or above it enter. Pairs that carry their ``score`` are not
    joined with the predictions for it. One walk over the sorted pairs settles all
    thresholds, see ``_walk``.
    """
    return _with_hits(predictions, _walk(_ranked_edges(predictions, pairs, thresholds), thresholds), thresholds)


def greedy_matches_in_rounds(predictions: DataFrame, pairs: DataFrame, thresholds=IOU_THRESHOLDS) -> DataFrame:
    """The same matches found by rounds over the whole cluster, without any walk."""
    edges = sized(_ranked_edges(predictions, pairs, thresholds))
    # an edge without another one at either end is settled at once; in most images these are nearly all
    ends = [F.count(F.lit(1)).over(Window.partitionBy(*_KEY, end)) for end in ("pred_id", "true_id")]
    counted = sized(edges.withColumn("_p", ends[0]).withColumn("_t", ends[1]).withColumn("_alone", F.expr("_p = 1 AND _t = 1")).drop("_p", "_t"))
    reached = F.lit(0).cast("long")
    for k, t in enumerate(thresholds):
        reached = reached + (F.col("iou") >= F.lit(float(t))).cast("long") * (1 << k)
    alone = counted.filter("_alone").select(*_KEY, "pred_id", reached.alias("hits"))
    return _with_hits(predictions, alone.unionByName(_mutual_best(counted.filter("NOT _alone").drop("_alone"), thresholds)), thresholds)


def _ranked_edges(predictions, pairs, thresholds):
    if not thresholds:
        raise ValueError("thresholds must not be empty")
    named = [c for c in ("score",) if c in pairs.columns]
    strong = pairs.filter(F.col("iou") >= min(thresholds)).select(*_KEY, "pred_id", "true_id", "iou", *named)
    if "score" in pairs.columns:
        return strong
    return strong.join(predictions.select(*_KEY, "pred_id", "score"), [*_KEY, "pred_id"])


def _with_hits(predictions, hits, thresholds):
    """``hits`` has one bit per threshold that a prediction was matched at.

    Most predictions match nothing. A bitmap of the matched ones, at most
    2**18 words, lets those pass at once; only the others are moved to meet
    their hits, which decide. So ``predictions`` are read twice.
    """
    bits = sized(hits.groupBy(*_KEY, "pred_id").agg(F.bit_or("hits").alias("_hits")))
    slot = F.xxhash64(*_KEY, "pred_id").bitwiseAND(F.lit((1 << _FILTER) - 1))
    word, bit = F.shiftright(slot, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = bits.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = predictions.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    sure = marked.filter(~may).drop("_word", "_bits").withColumn("_hits", F.lit(None).cast("long"))
    judged = marked.filter(may).drop("_word", "_bits").join(bits, [*_KEY, "pred_id"], "left")
    order = sorted(range(len(thresholds)), key=lambda k: thresholds[k])
    levels = F.array(
        *[F.when(F.col("_hits").bitwiseAND(F.lit(1 << k)) != 0, F.lit(float(thresholds[k]))) for k in order]
    )
    return judged.unionByName(sure).withColumn(
        "hit_thresholds", F.coalesce(F.array_compact(levels), F.array().cast("array<double>"))
    ).drop("_hits")


def _walk(edges: DataFrame, thresholds) -> DataFrame:
    """Matched ``(key, pred_id, hits)``, from one pass over the sorted edges.

    In (score, prediction, IoU, truth) order an edge is taken at a threshold
    exactly when both its ends are still free there. Edges stream through;
    only the bits of the instances of the current image and class are held.
    """
    levels = [float(t) for t in thresholds]
    schema = f"image_id {edges.schema['image_id'].dataType.simpleString()}, class int, pred_id string, hits long"

    def walk(batches):
        key, preds, truths = None, {}, {}
        for batch in batches:
            out = []
            for image, cls, pred, true, iou in zip(*(batch[c].tolist() for c in (*_KEY, "pred_id", "true_id", "iou"))):
                if (image, cls) != key:
                    key, preds, truths = (image, cls), {}, {}
                reached = sum(1 << k for k, t in enumerate(levels) if iou >= t)
                free = reached & ~preds.get(pred, 0) & ~truths.get(true, 0)
                if free:
                    preds[pred] = preds.get(pred, 0) | free
                    truths[true] = truths.get(true, 0) | free
                    out.append((image, cls, pred, free))
            yield pd.DataFrame(out, columns=[*_KEY, "pred_id", "hits"])

    ordered = edges.repartition(*_KEY).sortWithinPartitions(
        *_KEY, F.col("score").desc(), "pred_id", F.col("iou").desc(), "true_id"
    )
    return ordered.select(*_KEY, "pred_id", "true_id", "iou").mapInPandas(walk, schema)


def _mutual_best(edges: DataFrame, thresholds) -> DataFrame:
    """An edge that is the best of both its prediction (highest IoU) and its
    truth (highest-ranked prediction) is certain; taking all such edges at
    once and dropping whatever they block leaves a smaller problem of the same
    kind. The top-ranked prediction always settles, so this ends. Each round's
    matches go to a table of their own, so no plan grows.
    """
    key = [*_KEY, "level"]
    bits = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(thresholds)])
    pending = sized(
        edges.select("*", F.inline(bits)).filter(F.col("iou") >= F.col("threshold")).drop("threshold")
    )
    spark, path, rounds = edges.sparkSession, scratch_path(edges.sparkSession, "matches"), 0
    schema = edges.select(*_KEY, F.lit(0).alias("level"), "pred_id", "true_id").schema
    while True:
        by_pred = pending.groupBy(*key, "pred_id").agg(
            F.min(F.struct(-F.col("iou"), F.col("true_id")))["true_id"].alias("true_id")
        )
        by_truth = pending.groupBy(*key, "true_id").agg(
            F.min(F.struct(-F.col("score"), F.col("pred_id")))["pred_id"].alias("pred_id")
        )
        by_pred.join(by_truth, [*key, "pred_id", "true_id"]).select(schema.names).write.parquet(f"{path}/round={rounds}")
        agreed = spark.read.schema(schema).parquet(f"{path}/round={rounds}")
        rounds += 1
        pending = sized(
            pending.join(agreed.select(*key, "pred_id"), [*key, "pred_id"], "left_anti").join(
                agreed.select(*key, "true_id"), [*key, "true_id"], "left_anti"
            )
        )
        if pending.isEmpty():
            break
    taken = spark.read.schema(schema).parquet(*[f"{path}/round={k}" for k in range(rounds)])
    return taken.select(*_KEY, "pred_id", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")).alias("hits"))


def match_table(matches: DataFrame, thresholds=IOU_THRESHOLDS) -> DataFrame:
    """One row per prediction and threshold with ``is_tp``."""
    return matches.withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    ).select(
        *_KEY,
        "pred_id",
        "score",
        "threshold",
        F.array_contains("hit_thresholds", F.col("threshold")).alias("is_tp"),
    )


def precision_recall(matches: DataFrame, truths: DataFrame, thresholds=IOU_THRESHOLDS) -> DataFrame:
    """Precision and recall at every true positive, by falling score.

    Between true positives precision only falls while recall stands still, so
    these rows carry the whole curve. One global order per class serves all
    thresholds, each as one more running sum; a class with most of the rows
    spans many partitions. Equal scores order by image, then prediction id.
    """
    bit = lambda k: F.col("_hits").bitwiseAND(F.lit(1 << k)) != 0
    hits = F.lit(0).cast("long")
    for k, t in enumerate(thresholds):
        hits = hits + F.array_contains("hit_thresholds", F.lit(float(t))).cast("long") * (1 << k)
    ranked = running_totals(
        matches.select(*_KEY, "pred_id", "score", hits.alias("_hits")),
        [F.col("score").desc(), F.col("image_id"), F.col("pred_id")],
        sums={f"tp{k}": bit(k).cast("long") for k in range(len(thresholds))},
        partition_by=["class"],
        position="rank",
        keep=["class", "_hits"],
        where=F.col("_hits") != 0,
    )
    points = ranked.select(
        "class",
        "rank",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(t)).alias("threshold"),
                        bit(k).alias("is_tp"),
                        (F.col(f"tp{k}") + 1).alias("tp"),
                    )
                    for k, t in enumerate(thresholds)
                ]
            )
        ).alias("at"),
    ).filter("at.is_tp")
    return points.join(sized(truth_counts(truths)), "class").select(
        "class",
        F.col("at.threshold").alias("threshold"),
        "rank",
        (F.col("at.tp") / F.col("rank")).alias("precision"),
        (F.col("at.tp") / F.col("n_truth")).alias("recall"),
    )


def truth_counts(truths: DataFrame) -> DataFrame:
    """True instances per class; ``truths`` has one row per instance."""
    return truths.groupBy("class").agg(F.count(F.lit(1)).alias("n_truth"))


def average_precision(
    matches: DataFrame, truths: DataFrame, n_classes: int, thresholds=IOU_THRESHOLDS
) -> DataFrame:
    """101-point AP per class (not 0) and threshold.

    NULL without truth, 0 with truth but no true positive. Each true positive
    is filed under the highest recall level it reaches; at most 101 maxima per
    curve remain, from which the best precision at or beyond a level follows.
    """
    curve = precision_recall(matches, truths, thresholds)
    rough = F.floor(F.col("recall") * RECALL_STEPS)
    level = (
        F.when(F.col("recall") >= (rough + 1) / float(RECALL_STEPS), rough + 1)
        .when(F.col("recall") < rough / float(RECALL_STEPS), rough - 1)
        .otherwise(rough)
    )
    peaks = (
        curve.withColumn("level", F.least(level, F.lit(RECALL_STEPS)))
        .groupBy("class", "threshold", "level")
        .agg(F.max("precision").alias("peak"))
        .groupBy("class", "threshold")
        .agg(F.collect_list(F.struct("level", "peak")).alias("peaks"))
    )
    best = F.transform(
        F.sequence(F.lit(0), F.lit(RECALL_STEPS)),
        lambda lv: F.coalesce(
            F.array_max(
                F.transform(F.filter("peaks", lambda p: p["level"] >= lv), lambda p: p["peak"])
            ),
            F.lit(0.0),
        ),
    )
    ap = peaks.select(
        "class",
        "threshold",
        (F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v) / (RECALL_STEPS + 1)).alias("ap"),
    )
    grid = matches.sparkSession.range(1, n_classes).select(
        F.col("id").cast("int").alias("class"),
        F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"),
    )
    return (
        grid.join(truth_counts(truths), "class", "left")
        .join(ap, ["class", "threshold"], "left")
        .select(
            "class",
            "threshold",
            F.coalesce("n_truth", F.lit(0)).alias("n_truth"),
            F.when(F.col("n_truth") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"),
        )
    )


def map_per_threshold(ap: DataFrame) -> DataFrame:
    return ap.groupBy("threshold").agg(F.avg("ap").alias("map"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """One row: ``map_50`` and ``map``, the mean over all thresholds."""
    return map_per_threshold(ap).agg(
        F.max(F.when(F.col("threshold") == 0.5, F.col("map"))).alias("map_50"),
        F.avg("map").alias("map"),
    )
