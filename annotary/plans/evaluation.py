"""Instance-level evaluation of predicted scores against annotations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.operators import instances as inst
from annotary.operators import masks, taxonomy
from annotary.session import pinned


def truth_runs(images: DataFrame, instances: DataFrame, size=None, canonical=None) -> DataFrame:
    """Instance masks of annotations, kept distinct, optionally letterboxed.

    Without ``canonical`` every instance has class 1 (damage or not); with it
    the coarse class of its canonical name.
    """
    sized = instances.join(images.select("image_id", "width", "height"), "image_id")
    if canonical is None:
        classed = sized.withColumn("class", F.lit(1))
    else:
        classed = taxonomy.with_coarse_class(sized, canonical).withColumn(
            "class", F.col("class_index")
        )
    named = classed.withColumn("instance_id", F.format_string("%010d", F.col("pos")))
    runs = masks.polygon_runs(
        named.select("image_id", "class", "instance_id", "polygon", "width", "height")
    )
    if size is None:
        return runs
    return masks.letterbox_runs(
        runs.join(images.select("image_id", "width", "height"), "image_id"), size
    )


def evaluate_instances(scored_pixels: DataFrame, truth: DataFrame, n_classes: int):
    """``(ap, summary)`` from scored pixels and true instance runs."""
    predictions, predicted = masks.predicted_instances(scored_pixels)
    return evaluate_masks(
        predictions.withColumnRenamed("instance_id", "pred_id"), predicted, truth, n_classes
    )


def evaluate_masks(predictions: DataFrame, predicted: DataFrame, truth: DataFrame, n_classes: int):
    """The same for instances that already carry a score and runs."""
    pairs = inst.overlapping_pairs(predicted, truth)
    matches = pinned(inst.greedy_matches(predictions, pairs))
    truths = truth.select("image_id", "class", "instance_id").distinct()
    ap = pinned(inst.average_precision(matches, truths, n_classes))
    return ap, inst.mean_average_precision(ap)
