"""Sessions on live time stamps, one timeline per key."""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annotary.operators.sessions import SESSION_GAP_SECONDS


def live_sessions(
    stream: DataFrame, keys, id_col, ts_col, delay="10 minutes", gap_seconds=SESSION_GAP_SECONDS
) -> DataFrame:
    """Closed sessions in append mode: key, first id, bounds, events.

    The same gap rule as in batch. Two differences come with a stream: rows
    later than the watermark are dropped, and a session shows up only once the
    watermark has passed its end.
    """
    opener = F.min(F.struct(ts_col, id_col))
    return (
        stream.withWatermark(ts_col, delay)
        .groupBy(*keys, F.session_window(ts_col, f"{gap_seconds} seconds").alias("window"))
        .agg(
            opener[id_col].alias("session_id"),
            F.min(ts_col).alias("first_ts"),
            F.max(ts_col).alias("last_ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .drop("window")
    )


class _Sessions(StatefulProcessor):
    """The open sessions of one key; rows may arrive in any order.

    A key has one value, read and written once a micro-batch, and one timer,
    at the earliest end of its sessions.
    """

    def __init__(self, fields, gap):
        self.fields, self.gap = fields, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "sessions binary, timer long")

    def _row(self, key, first, session, state):
        last, opener, n = session
        return Row(**dict(zip(self.fields, key)), session_id=opener, first_us=first, last_us=last, n_events=n, state=state)

    def _end(self, last):
        return (last + self.gap) // 1000 + 1

    def _load(self):
        """``{first: (last, opener, n)}`` and the time of the timer, if one is set."""
        found = self.state.get()
        if found is None:
            return {}, None
        table = np.frombuffer(bytes(found[0]), np.int64).reshape(-1, 4).tolist()
        return {first: (last, opener, n) for first, last, opener, n in table}, found[1]

    def _store(self, sessions, timer):
        if not sessions:
            self.state.clear()
            return
        earliest = min(self._end(last) for last, _, _ in sessions.values())
        if timer is None or earliest < timer:
            self.handle.registerTimer(earliest)
            timer = earliest
        table = np.array([(first, *session) for first, session in sessions.items()], np.int64)
        self.state.update((table.tobytes(), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old, timer = self._load()
        spans = [(first, *session, False) for first, session in old.items()]
        spans += [(row.us, row.us, row.id, 1, True) for row in rows]
        spans.sort(key=lambda s: (s[0], s[2]))
        merged = []  # first, last, opener, n, changed
        for first, last, opener, n, fresh in spans:
            if merged and first - merged[-1][1] <= self.gap:
                m = merged[-1]
                merged[-1] = (m[0], max(m[1], last), m[2], m[3] + n, True)
            else:
                merged.append((first, last, opener, n, fresh))
        known = {m[2] for m in merged}
        self._store({first: (last, opener, n) for first, last, opener, n, _ in merged}, timer)
        for first, session in old.items():
            if session[1] not in known:
                yield self._row(key, first, (*session[:2], 0), "merged")
        for first, last, opener, n, changed in merged:
            if changed:
                yield self._row(key, first, (last, opener, n), "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a session may have grown since the timer was set, and others may have ended with it
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        sessions, _ = self._load()
        closed = {first: session for first, session in sessions.items() if self._end(session[0]) <= now}
        self._store({first: session for first, session in sessions.items() if first not in closed}, None)
        for first, session in closed.items():
            yield self._row(key, first, session, "closed")

    def close(self) -> None:
        pass


def corrected_sessions(
    stream: DataFrame, keys, id_col, ts_col, delay="10 minutes", gap_seconds=SESSION_GAP_SECONDS
) -> DataFrame:
    """Sessions as they grow, in update mode: keys, session_id, first_ts, last_ts, n_events, state.

    A session is given out as soon as it has an event (``open``), again
    whenever a row changes it, and once more when the watermark has passed its
    end (``closed``); then it leaves the state. A late row within ``delay`` may
    open an earlier session, extend one or join two: the id that no longer
    exists is given out with no events (``merged``). The newest row of each
    (keys, session_id) is the truth; ``current_sessions`` keeps those with
    events. Ids are longs. Needs the RocksDB state store (``sinks.rocksdb_state``).
    """
    keys = list(keys)
    fields = [stream.schema[k] for k in keys]
    names = ["session_id", "first_us", "last_us", "n_events"]
    schema = T.StructType(
        fields + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("state", T.StringType())]
    )
    # the watermark already lags by ``delay``; a session may still grow until it has passed its end by the gap
    timed = stream.filter(F.col(ts_col).isNotNull()).withWatermark(ts_col, delay)
    found = (
        timed.select(*keys, F.col(id_col).cast("long").alias("id"), F.unix_micros(ts_col).alias("us"), ts_col)
        .groupBy(*keys)
        .transformWithState(_Sessions(keys, gap_seconds * 1_000_000), schema, "Update", "EventTime")
    )
    return found.select(
        *keys,
        "session_id",
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"),
        "n_events",
        "state",
    )


def current_sessions(newest: DataFrame) -> DataFrame:
    """The sessions that exist, from the newest row of each (keys, session_id)."""
    return newest.filter(F.col("state") != "merged")
