"""Live progress of runs: last events, percent done and time left, silent runs."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annotary import schemas
from annotary.operators.runs import last_events, run_progress
from annotary.session import sized
from annotary.sources.run_files import named_by_folder


def event_stream(spark: SparkSession, path) -> DataFrame:
    """Event files as a stream, campaign and run taken from their folders. A
    file is read once: events must land as new files, not as appends (for those
    see ``sources.tail``)."""
    return named_by_folder(
        spark.readStream.schema(schemas.RUN_EVENT).option("mode", "DROPMALFORMED").json(path)
    )


def live_last_events(events: DataFrame, run_keys=("run",)) -> DataFrame:
    """Newest event per (run, kind); state is one row each. Mode ``update``."""
    return last_events(events, run_keys)


def live_progress(events: DataFrame, targets: DataFrame, run_keys=("run",)) -> DataFrame:
    """Percent done, seconds per iteration and seconds left, while events arrive. Mode ``update``.

    The last events are the state; run targets are a table that each
    micro-batch is joined with, so a changed run gives one changed row.
    """
    return run_progress(live_last_events(events, run_keys), sized(targets), run_keys)


class _Silence(StatefulProcessor):
    """Newest iteration of a run, and a timer that speaks up when nothing follows."""

    def __init__(self, keys, seconds):
        self.keys, self.milliseconds = keys, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "iteration long")

    def _row(self, key, state):
        iteration = self.newest.get()[0]
        return Row(**dict(zip(self.keys, key)), iteration=iteration, state=state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [row.iteration for row in rows if row.iteration is not None]
        if self.newest.exists():
            found.append(self.newest.get()[0])
        if not found:
            return
        self.newest.update((max(found),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        yield self._row(key, "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, "silent")

    def close(self) -> None:
        pass


def run_states(events: DataFrame, run_keys=("run",), silent_after=600.0) -> DataFrame:
    """``(keys, iteration, state)``: ``running`` whenever events arrive, ``silent`` after that many seconds without.

    A processing-time timer per run; state is one number a run. Needs the
    RocksDB state store (``sinks.rocksdb_state``).
    """
    keys = list(run_keys)
    schema = T.StructType([events.schema[k] for k in keys] + [T.StructField("iteration", T.LongType()), T.StructField("state", T.StringType())])
    return (
        events.select(*keys, F.col("iteration").cast("long").alias("iteration"))
        .groupBy(*keys)
        .transformWithState(_Silence(keys, silent_after), schema, "Update", "ProcessingTime")
    )
