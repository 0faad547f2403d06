"""Running evaluation over an unbounded stream of scored rows."""

from pyspark.sql import DataFrame

from annotary.operators import scored as m


def once(stream: DataFrame, keys, ts_col, delay) -> DataFrame:
    """Each row of the stream once, however often its file is delivered.

    ``keys`` (image and row, say) name a row. They stay in the state until the
    watermark, ``delay`` behind the newest ``ts_col``, has passed them: a row
    delivered again within ``delay`` is dropped, one that is later than that is
    dropped as late. So is one of 1970 or before, where watermarks begin.
    """
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(list(keys))


def running_confusion(scored: DataFrame, n_classes: int) -> DataFrame:
    """Stream of ``(target, pred, n)`` counts, state bounded by K x K rows.

    Use output mode ``complete``; ``scored.complete_grid`` and the class
    scores apply to each emitted table. Delivered twice, rows count twice:
    pass them through ``once`` first where that may happen.
    """
    return m.confusion_counts(m.with_prediction(scored), n_classes)


def running_cube(scored: DataFrame, n_classes: int, n_bins: int = m.N_BINS) -> DataFrame:
    """The whole score cube as streaming state: K x K x bins rows, no watermark
    needed. Every batch metric is computed from it as in the batch case."""
    return m.score_cube(scored, n_classes, n_bins)
