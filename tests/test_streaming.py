"""Streams that have caught up equal their batch results."""

import json
import time

import pytest
from pyspark.sql import functions as F

from annotary.operators import runs, scored
from annotary.plans import standin
from annotary.sources import tail
from annotary.streaming import progress, sessions, sinks
from annotary.streaming import scored as live

SCORED = "target int, probs array<double>"


def test_scored_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, [0.2 + 0.1 * (k % 4), 0.5 - 0.1 * (k % 4), 0.3]) for k in range(60)]
    df = spark.createDataFrame(rows, SCORED)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = scored.complete_grid(sinks.drain_complete(live.running_confusion(stream, 3), "c"), 3)
    batch = scored.confusion(scored.with_prediction(df), 3)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, batch.collect()))
    cube = sinks.drain_complete(live.running_cube(stream, 3), "cube")
    brier = scored.brier_score(cube).first()[0]
    assert abs(brier - scored.brier_score(scored.score_cube(df, 3)).first()[0]) < 1e-12


def test_progress_stream_equals_batch(spark, tmp_path):
    for run in ("r1", "r2"):
        folder = tmp_path / "root" / "camp" / run
        folder.mkdir(parents=True)
        for part in range(3):
            events = [{"type": t, "iteration": 10 * part + k, "loss": 1.0 / (1 + k)} for k in range(3) for t in ("train", "val")]
            (folder / f"{part}.jsonl").write_text("\n".join(map(json.dumps, events)) + '\n{"type": "tr')
    path = str(tmp_path / "root/*/*")
    stream = progress.live_last_events(progress.event_stream(spark, path), ["campaign", "run"])
    got = {(r["run"], r["type"]): r["iteration"] for r in sinks.drain_complete(stream, "p").collect()}
    assert got == {(r, t): 22 for r in ("r1", "r2") for t in ("train", "val")}


def test_session_stream(spark, tmp_path):
    start = 1_700_000_000
    rows = [(k, "u", start + s) for k, s in enumerate([0, 60, 121, 500, 5000])]
    df = spark.createDataFrame(rows, "id long, user string, s long").select(
        "id", "user", F.timestamp_seconds("s").alias("ts")
    )
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    closed = sinks.drain_append(sessions.live_sessions(stream, ["user"], "id", "ts", "10 seconds"), "s")
    assert sorted((r["session_id"], r["n_events"]) for r in closed.collect()) == [(0, 2), (2, 1), (3, 1)]


def test_result_rows(spark):
    spec = spark.createDataFrame([("50,full", "42", "4+,1")], "points string, seeds string, buckets string")
    done = spark.createDataFrame(
        [("n50_seed42", 42, 50, 0.5, 10, 1.0), ("n50_density4+_seed42", 42, 50, 0.4, 9, 2.0)],
        "run string, seed int, num_train_images int, best_val_iou double, best_iteration int, elapsed_seconds double",
    )
    volume = runs.result_rows(runs.run_grid(spec), done, "/runs")
    assert volume.columns == runs.VOLUME_ROW
    assert [(r["subset_n_images"], r["output_dir"]) for r in volume.collect()] == [("50", "/runs/n50_seed42")]
    density = runs.result_rows(runs.run_grid(spec, density=True), done, "/runs", density=True)
    assert density.columns == runs.DENSITY_ROW and density.first()["density_bucket"] == "4+"


def test_rows_delivered_again_count_once(spark, tmp_path):
    rows = [(k, 1_700_000_000 + k, k % 3, [0.2 + 0.1 * (k % 4), 0.5 - 0.1 * (k % 4), 0.3]) for k in range(40)]
    df = spark.createDataFrame(rows, "row_id long, s long, target int, probs array<double>")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    for part in (0, 1, 0, 1, 1):
        df.filter(F.col("row_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = sinks.drain_complete(live.running_confusion(live.once(stream, ["row_id"], "ts", "1 hour"), 3), "once")
    batch = scored.confusion_counts(scored.with_prediction(df), 3)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, batch.collect()))


def landed(spark, path, batches, schema="id long, user string, s long"):
    for rows in batches:
        df = spark.createDataFrame(rows, schema).select("id", "user", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sessions_are_corrected_by_late_rows(spark, tmp_path):
    batches = [
        [(1, "u", 0), (2, "u", 200), (3, "v", 0)],
        [(4, "u", 100), (5, "u", 50)],  # joins both sessions of u, one step after the other
        [(6, "u", -50), (7, "u", 1000)],  # an earlier opener, and a session of its own
    ]
    stream = landed(spark, str(tmp_path / "in"), batches)
    with sinks.rocksdb_state(spark):
        found = sessions.corrected_sessions(stream, ["user"], "id", "ts", "1 day", 100)
        newest = sinks.drain_update(found, "sessions", ["user", "session_id"]).cache()
    got = {(r.user, r.session_id): (r.n_events, r.state) for r in newest.collect()}
    assert got == {("u", 1): (0, "merged"), ("u", 2): (0, "merged"), ("u", 6): (5, "open"), ("u", 7): (1, "open"), ("v", 3): (1, "open")}
    now = sessions.current_sessions(newest)
    assert {(r.user, r.session_id) for r in now.collect()} == {("u", 6), ("u", 7), ("v", 3)}


def test_closed_sessions_leave_the_state(spark, tmp_path):
    batches = [[(1, "u", 0), (2, "u", 30)], [(3, "w", 5000)], [(4, "w", 9000)]]
    stream = landed(spark, str(tmp_path / "in"), batches)
    with sinks.rocksdb_state(spark):
        found = sessions.corrected_sessions(stream, ["user"], "id", "ts", "10 seconds")
        newest = sinks.drain_update(found, "sessions", ["user", "session_id"])
    got = {(r.user, r.session_id): (r.n_events, r.state) for r in newest.collect()}
    assert got == {("u", 1): (2, "closed"), ("w", 3): (1, "closed"), ("w", 4): (1, "open")}


def test_live_progress_and_silent_runs(spark, tmp_path):
    path = str(tmp_path / "in")
    events = spark.createDataFrame(
        [("r1", "train", 10, 0.5), ("r1", "train", 40, 0.3), ("r2", "train", 0, 0.9), ("r2", "val", 5, 0.1)],
        "run string, type string, iteration long, loss double",
    )
    events.repartition(2).write.json(path)
    targets = spark.createDataFrame([("r1", 100, 80.0), ("r2", 50, 9.0)], "run string, iterations int, elapsed_seconds double")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(path)
    got = {r.run: r for r in sinks.drain_update(progress.live_progress(stream, targets), "eta", ["run"]).collect()}
    batch = {r.run: r for r in runs.run_progress(runs.last_events(events), targets).collect()}
    assert got == batch and got["r1"].percent == 40 and got["r1"].seconds_left == 120 and got["r2"].seconds_left == 0
    with sinks.rocksdb_state(spark):
        states = progress.run_states(spark.readStream.schema(events.schema).json(path), silent_after=1.0)
        query = (
            states.writeStream.format("memory").queryName("run_states").outputMode("update").trigger(processingTime="1 second").start()
        )
        try:
            deadline = time.time() + 90
            while time.time() < deadline:
                rows = {(r.run, r.iteration, r.state) for r in spark.table("run_states").collect()}
                if len(rows) == 4:
                    break
                time.sleep(1)
        finally:
            query.stop()
    assert rows == {("r1", 40, "running"), ("r2", 5, "running"), ("r1", 40, "silent"), ("r2", 5, "silent")}


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_line_ranges_cover_every_line_once(tmp_path, width):
    text = b"one\n\nthree and more\n4\nfive\nhalf a li"
    (tmp_path / "log.jsonl").write_bytes(text)
    system, _ = tail.file_system(str(tmp_path))
    path = str(tmp_path / "log.jsonl")
    stop = tail.complete_until(system, path, 0, len(text))
    assert text[:stop].endswith(b"five\n")
    got = []
    for at in range(0, stop, width):
        got += list(tail.lines_of(system, tail.LineRange(path, at, min(stop, at + width), stop)))
    assert got == [(0, b"one"), (4, b""), (5, b"three and more"), (20, b"4"), (22, b"five")]
    assert tail.complete_until(system, path, stop, len(text)) == stop


def test_growing_logs(spark, tmp_path):
    folder = tmp_path / "camp" / "r1"
    folder.mkdir(parents=True)
    log, place = folder / "events.jsonl", sinks.new_place(spark, "tailed")

    def read():
        table = sinks.drain_append(tail.tail_events(spark, str(tmp_path), rangeBytes=16), "tailed", place)
        return sorted((r.campaign, r.run, r.iteration or 0) for r in table.collect())

    log.write_text('{"type": "train", "iteration": 1}\nnot an event\n{"type": "tra')
    assert read() == [("camp", "r1", 1)]
    with log.open("a") as out:
        out.write('in", "iteration": 2}\n')
    (folder / "other.txt").write_text('{"type": "train", "iteration": 9}\n')
    assert read() == [("camp", "r1", 1), ("camp", "r1", 2)]
    assert read() == [("camp", "r1", 1), ("camp", "r1", 2)]
    log.write_text('{"type": "v"}\n')  # a new, shorter file under the old name
    assert [r[2] for r in read()] == [0, 1, 2]


def test_landed_files_follow_the_table(spark, tmp_path):
    """A table of more partitions lands in more files, still in two micro-batches."""
    spark.range(0, 1000, 1, 12).write.parquet(str(tmp_path / "t.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        stream = standin.landed(spark, str(tmp_path), "t").withColumn("file", F.input_file_name())
        seen = {}
        query = stream.writeStream.foreachBatch(lambda b, k: seen.__setitem__(k, (b.count(), b.select("file").distinct().count()))).trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])
    assert sum(n for n, _ in seen.values()) == 1000
    assert len(seen) == 2 and all(files >= 4 for _, files in seen.values())


def test_tail_ranges_stay_bounded(tmp_path):
    """Many new bytes are read in wider ranges, which still cover every byte once."""
    reader = tail.LineTailReader({"path": str(tmp_path), "rangeBytes": "10"})
    parts = reader.partitions({"files": {"a": 50}}, {"files": {"a": 1_000_050, "b": 7}})
    assert len(parts) <= tail.MOST_RANGES + 2
    spans = sorted((p.path, p.begin, p.end) for p in parts)
    assert spans[0][1] == 50 and spans[-1] == ("b", 0, 7)
    assert all(x[2] == y[1] for x, y in zip(spans, spans[1:]) if x[0] == y[0])
    assert len(reader.partitions({"files": {}}, {"files": {"a": 100}})) == 10


def test_a_key_of_many_sessions_has_one_value_and_one_timer():
    """State calls do not grow with the sessions of a key."""
    calls = []

    class Value:
        row = None

        def get(self):
            return self.row

        def update(self, row):
            calls.append("update")
            self.row = row

        def clear(self):
            self.row = None

    class Handle:
        value = Value()
        getValueState = lambda self, *_: self.value
        registerTimer = lambda self, at: calls.append(at)

    class Now:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 10**12

    field = type("Row", (), {})
    rows = []
    for k in range(40):
        row = field()
        row.us, row.id = k * 10_000_000, k
        rows.append(row)
    processor = sessions._Sessions(["user"], 1_000_000)
    processor.init(Handle())
    assert len(list(processor.handleInputRows(("u",), iter(rows), None))) == 40
    assert calls == [1001, "update"]
    assert [r.state for r in processor.handleExpiredTimer(("u",), Now(), Now())] == ["closed"] * 40
    assert Handle.value.row is None and len(calls) == 2
