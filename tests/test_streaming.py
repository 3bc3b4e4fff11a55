"""A stream gives what the batch query gives, however its lines arrive."""

import itertools
import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from helpers import NOW, claims, jobs, nodes, rows
from pyspark.sql import functions as F

from runlens import fixtures as fx
from runlens import schemas
from runlens.operators import runs
from runlens.streaming import jobs as job_streams
from runlens.streaming import logs, snapshots
from runlens.streaming.sinks import batch_folder, newest_rows, start, start_to_folder

SF = "/root/testdata/sf0.001"


def at(seconds):
    return datetime.fromtimestamp(seconds, UTC)


CLOCK = itertools.count(1_700_000_000)


def write_json(folder, name, records):
    """A file later than all before it; one without records still counts as a file."""
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{name}.json"
    path.write_text("\n".join(json.dumps(r, default=lambda d: d.isoformat()) for r in records) or "\n")
    os.utime(path, (tick := next(CLOCK), tick))


def read_json(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """fx_log in five files by time, then one file of earlier lines in no order and sent again."""
    folder = tmp_path_factory.mktemp("arrivals")
    log = fx.log(spark, SF).orderBy("ts", "event_id").toPandas()
    records = [
        {"event_id": int(r.event_id), "run_id": r.run_id, "ts": r.ts.isoformat() + "Z", "line": r.line}
        for r in log.itertuples()
    ]
    late = records[30:90]
    for i in range(5):
        write_json(folder, f"part-{i}", [r for r in records[i * 200 : (i + 1) * 200] if r not in late])
    write_json(folder, "part-5", late[::-1] + records[100:150])
    return folder


def lines(spark, folder):
    stream = read_json(spark, folder, schemas.LOG_LINES)
    return stream.withColumnRenamed("event_id", "line_no")


def test_progress_stream_equals_batch(spark, arrivals, tmp_path):
    folder = str(tmp_path / "rows")
    stream = logs.latest_progress_stream(lines(spark, arrivals))
    start_to_folder(stream, folder, str(tmp_path / "c"), "update").awaitTermination()
    latest = newest_rows(spark.read.parquet(folder), ["run_id"], [F.col("ts"), F.col("line_no")])
    assert rows(latest, "run_id", "progress") == rows(runs.latest_progress(fx.log(spark, SF)), "run_id", "progress")
    assert spark.read.parquet(folder).select("batch").distinct().count() > 1


def test_epoch_stream_equals_batch(spark, arrivals, tmp_path):
    folder = str(tmp_path / "rows")
    once = str(tmp_path / "once")
    start(lines(spark, arrivals), logs.distinct_lines_handler(once), str(tmp_path / "c0")).awaitTermination()
    clean = spark.readStream.schema(lines(spark, arrivals).schema).parquet(once)
    start_to_folder(logs.epoch_stream(clean), folder, str(tmp_path / "c")).awaitTermination()
    expected = runs.epoch_marks(fx.log(spark, SF))
    assert rows(spark.read.parquet(folder), "line_no", "epoch") == rows(expected, "line_no", "epoch")


def test_durations_equal_batch_for_shuffled_and_repeated_lines(spark, arrivals, tmp_path):
    whole = fx.runs(spark, SF)
    ends = tmp_path / "ends"
    stops = [
        {"run_id": r.run_id, "started_at": r.started_at.isoformat() + "Z", "ended_at": "2024-02-01T00:00:00Z"}
        for r in whole.collect()
    ]
    # The ends come in the last of several files, after every line.
    for i in range(20):
        write_json(ends, f"part-{i:02}", stops if i == 19 else [])
    ended = read_json(spark, ends, "run_id string, started_at timestamp, ended_at timestamp")
    once = str(tmp_path / "once")
    start(lines(spark, arrivals), logs.distinct_lines_handler(once), str(tmp_path / "c0")).awaitTermination()
    clean = spark.readStream.schema(lines(spark, arrivals).schema).option("maxFilesPerTrigger", 3).parquet(once)
    events = logs.run_events(logs.epoch_stream(clean), ended)
    folder = str(tmp_path / "rows")
    long = 90 * 24 * 3600
    stream = logs.run_duration_stream(events, delay="60 days", limit_seconds=long)
    start_to_folder(stream, folder, str(tmp_path / "c")).awaitTermination()
    found = spark.read.parquet(folder).select("run_id", "n_marks", F.round("duration_seconds", 2).alias("d"))
    batch_runs = whole.withColumn("ended_at", F.lit("2024-02-01").cast("timestamp"))
    batch = runs.run_duration(runs.epoch_marks(fx.log(spark, SF)), batch_runs)
    assert rows(found) == rows(batch.select("run_id", "n_marks", F.round("duration_seconds", 2).alias("d")))


MARKS = "run_id string, line_no long, epoch long, ts timestamp"
ENDS = "run_id string, started_at timestamp, ended_at timestamp"


def durations(spark, tmp_path, batches, **kw):
    """Run batches of (marks, ends), one micro-batch each."""
    for i, (points, stops) in enumerate(batches):
        marks = [{"run_id": r, "line_no": n, "epoch": e, "ts": at(t)} for r, n, e, t in points]
        write_json(tmp_path / "marks", f"part-{i}", marks)
        write_json(tmp_path / "ends", f"part-{i}", [{"run_id": r, "started_at": at(a), "ended_at": at(b)} for r, a, b in stops])
    events = logs.run_events(read_json(spark, tmp_path / "marks", MARKS), read_json(spark, tmp_path / "ends", ENDS))
    folder = str(tmp_path / "rows")
    query = start_to_folder(logs.run_duration_stream(events, **kw), folder, str(tmp_path / "c"))
    query.awaitTermination()
    return rows(spark.read.parquet(folder), "run_id", "outcome", "n_marks", "duration_seconds")


def test_golden_duration_over_two_batches(spark, tmp_path):
    first = [("r", 1, 50, 10), ("r", 3, 150, 19)]
    second = [("r", 4, 200, 23), ("r", 2, 100, 15)]
    assert durations(spark, tmp_path, [(first, []), (second, [("r", 0, 60)])]) == [("r", "ended", 4, 800.0)]


def test_short_runs_and_late_lines_after_the_end(spark, tmp_path):
    batches = [
        ([("r", 1, 5, 10)], [("r", 4, 30)]),
        ([("r", 2, 6, 12), ("r", 3, 7, 14), ("s", 1, 1, 14)], []),
        ([], [("s", 10, 40)]),
    ]
    assert durations(spark, tmp_path, batches) == [("r", "ended", 1, 26.0), ("s", "ended", 1, 30.0)]


def test_timeout(spark, tmp_path):
    day = 24 * 3600
    batches = [
        ([("slow", i, i, i * 10) for i in range(1, 5)] + [("quick", 1, 1, 10)], []),
        ([("other", 1, 1, 3 * day)], [("quick", 0, day)]),
        ([("other", 2, 2, 3 * day + 10)], []),
    ]
    found = durations(spark, tmp_path, batches)
    assert ("slow", "timeout", 4, 40.0) in found and ("quick", "ended", 1, float(day)) in found
    assert all(run != "other" for run, *_ in found)


CHANGES = "id string, status string, seq long"


def test_upserts_count_each_job_once_and_replays_change_nothing(spark, tmp_path):
    table = jobs(spark, *[{"id": f"j{i}"} for i in range(3)])
    newest = [F.col("seq")]
    parts = [
        [("j0", "RUNNING", 1), ("j0", "SUCCEEDED", 2), ("j1", "RUNNING", 3)],
        [("j1", "FAILED", 5), ("j0", "RUNNING", 0)],
    ]
    for i, part in enumerate(parts):
        write_json(tmp_path / "in", f"part-{i}", [dict(zip(("id", "status", "seq"), p, strict=True)) for p in part])
    folder = str(tmp_path / "rows")
    handler = job_streams.upsert_handler(folder, newest)
    start(read_json(spark, tmp_path / "in", CHANGES), handler, str(tmp_path / "c")).awaitTermination()
    for _ in range(2):
        changes = spark.read.parquet(folder)
        now = F.lit(NOW)
        assert rows(job_streams.current_jobs(table, changes, newest, now), "id", "status") == [
            ("j0", "SUCCEEDED"),
            ("j1", "FAILED"),
            ("j2", "QUEUED"),
        ]
        assert tuple(job_streams.live_status_counts(table, changes, newest, now).first()) == (3, 1, 0, 0, 2)
        handler(spark.createDataFrame(parts[1], CHANGES), 1)


def test_repeated_dispatches_are_dropped(spark, tmp_path):
    sent = [{"id": i, "attempt": a, "ts": at(t)} for i, a, t in [("x", 1, 0), ("x", 1, 5), ("x", 2, 9), ("y", 1, 9)]]
    write_json(tmp_path / "in", "a", sent)
    write_json(tmp_path / "in", "b", sent[:2])
    stream = read_json(spark, tmp_path / "in", "id string, attempt int, ts timestamp")
    folder = str(tmp_path / "rows")
    start(stream, job_streams.dispatch_handler(folder), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(folder), "id", "attempt") == [("x", 1), ("x", 2), ("y", 1)]


def test_a_first_dispatch_hours_late_is_kept(spark, tmp_path):
    for name, at_ in (("x", 10), ("x", 20), ("y", 20.2), ("z", 12), ("w", 21), ("z", 12)):
        write_json(tmp_path / "in", f"{name}-{next(CLOCK)}", [{"id": name, "attempt": 1, "ts": at(at_ * 3600)}])
    stream = read_json(spark, tmp_path / "in", "id string, attempt int, ts timestamp")
    folder = str(tmp_path / "rows")
    start(stream, job_streams.dispatch_handler(folder), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(folder), "id") == [("w",), ("x",), ("y",), ("z",)]
    handler = job_streams.dispatch_handler(folder)
    handler(spark.createDataFrame([("z", 1, at(0)), ("v", 1, at(5))], "id string, attempt int, ts timestamp"), 99)
    assert rows(spark.read.parquet(folder).where("batch = 99"), "id") == [("v",)]


def test_late_lines_of_ended_runs_are_made_up_for(spark, tmp_path):
    """Two marks, time moves on by hours, then two more marks and the end: the batch rule sees four."""
    hour = 3600
    batches = [
        ([("r", 1, 1, 10 * hour), ("r", 2, 2, 10.5 * hour)], []),
        ([("s", 1, 1, 20 * hour)], []),
        ([("s", 2, 2, 20.25 * hour)], []),
        ([("r", 3, 3, 12 * hour), ("r", 4, 4, 13 * hour)], [("r", 9 * hour, 20.5 * hour)]),
    ]
    durations(spark, tmp_path, batches)
    closed = spark.read.parquet(str(tmp_path / "rows")).select("run_id", "outcome", "n_marks", "duration_seconds")
    marks = spark.read.schema(MARKS).json(str(tmp_path / "marks"))
    ends = spark.read.schema(ENDS).json(str(tmp_path / "ends")).where("run_id is not null")
    marks = marks.where("run_id is not null")
    corrected = rows(logs.corrected_durations(closed, marks, ends), "run_id", "n_marks", "duration_seconds")
    assert ("r", 4, 18_000.0) in corrected


def test_replan_builds_on_the_batch_before_and_can_be_repeated(spark, tmp_path):
    waiting = jobs(spark, *[{"id": f"i{n}", "created_at": NOW + timedelta(seconds=n)} for n in range(1, 4)])
    held = claims(spark, ("t", {"A": 1}, None, "i1"))
    frame = nodes(spark, ("p", True, {"A": 3}))
    schema = "job_id string, config_key string, node_id string, duration_seconds double, seq long"
    first = [("t", '{"A":1}', "p", 5.0, 1)]
    second = [("t", '{"A":2}', "p", 4.0, 2), ("t", '{"A":1}', "p", 9.0, 3)]
    for name, batch in (("a", first), ("b", second)):
        fields = ("job_id", "config_key", "node_id", "duration_seconds", "seq")
        write_json(tmp_path / "in", name, [dict(zip(fields, r, strict=True)) for r in batch])
    folder = str(tmp_path / "rows")
    handler = job_streams.replan_handler(lambda _: (waiting, held, frame), folder, [F.col("seq")], now=F.lit(NOW))
    start(read_json(spark, tmp_path / "in", schema), handler, str(tmp_path / "c")).awaitTermination()

    def plan(batch):
        return rows(spark.read.parquet(batch_folder(f"{folder}/plan", batch)), "id", "mode", "config_key", "node_id")

    def stored(batch):
        kept = spark.read.parquet(batch_folder(f"{folder}/claims", batch))
        return rows(kept, "config_key", "instance_id", "duration_seconds")

    # i1 has used its claim up; i2 and i3 take what is left to profile.
    one = '{"A":1}'
    assert plan(0) == [("i1", "standard", one, "p"), ("i2", "profiling", '{"A":2}', "p"), ("i3", "profiling", '{"A":3}', "p")]
    assert stored(0) == [(one, "i1", 5.0), ('{"A":2}', "i2", None), ('{"A":3}', "i3", None)]
    for _ in range(2):
        assert [p[1:] for p in plan(1)] == [("standard", one, "p")] * 3
        assert stored(1) == [(one, "i1", 5.0), ('{"A":2}', "i2", 4.0), ('{"A":3}', "i3", None)]
        handler(spark.createDataFrame(second, schema), 1)


def test_recovery_runs_once_per_start_and_the_stream_goes_on(spark, tmp_path):
    table = jobs(spark, {"id": "aaaaaaaa1", "status": "RUNNING"}, {"id": "bbbbbbbb1"})
    live = spark.createDataFrame([], "name string")
    assert rows(job_streams.recovery(table, live)) == [("aaaaaaaa1", "fail"), ("bbbbbbbb1", "dispatch")]
    recovered, handled = [], []

    def run():
        handler = job_streams.recovering(
            lambda frame, batch: handled.append((batch, frame.count())), lambda _, batch: recovered.append(batch)
        )
        start(read_json(spark, tmp_path / "in", CHANGES), handler, str(tmp_path / "c")).awaitTermination()

    change = {"id": "x", "status": "RUNNING", "seq": 1}
    write_json(tmp_path / "in", "a", [change])
    write_json(tmp_path / "in", "b", [change, change])
    run()
    write_json(tmp_path / "in", "c", [change])
    run()
    assert recovered == [0, 2] and [n for _, n in handled] == [1, 2, 1]


def test_a_look_reads_the_changes_since_the_snapshot(spark, tmp_path):
    """Over forty batches, every look reads one snapshot and fewer batches than a fold takes; replays change nothing."""
    folder, newest = str(tmp_path / "latest"), [F.col("ts"), F.col("n")]
    handler = snapshots.latest_handler(folder, ["id"], newest, every=5)
    expected, seen = {}, []
    assert snapshots.latest(spark, folder, ["id"], newest) is None
    for batch in range(40):
        changes = [(f"k{(batch * 7 + i) % 40}", (batch * 13 + i) % 50, batch * 3 + i) for i in range(3)]
        for key, ts, n in changes:
            expected[key] = max(expected.get(key, (-1, -1)), (ts, n))
        frame = spark.createDataFrame(changes, "id string, ts int, n int")
        handler(frame, batch)
        if batch in (4, 17, 34):
            handler(frame, batch)
        if batch % 10 == 9 or batch == 17:
            found = {r["id"]: (r["ts"], r["n"]) for r in snapshots.latest(spark, folder, ["id"], newest).collect()}
            assert found == expected
        seen.append(snapshots.rows_to_read(spark, folder))
    assert max(b for _, b in seen) < 5 and {s for s, _ in seen} == {0, 1}
    assert len(os.listdir(f"{folder}/changes")) <= 10 and len(os.listdir(f"{folder}/snapshots")) == 2


def test_progress_survives_the_end_of_its_state(spark, tmp_path):
    arrivals, out = tmp_path / "arrivals", str(tmp_path / "progress")
    days = [[("a", 1, 0, 1), ("b", 2, 0, 1)], [("a", 3, 1, 2)], [("c", 4, 40, 1)], [("c", 5, 90, 3)], [("b", 6, 91, 7)]]
    for k, day in enumerate(days):
        write_json(arrivals, str(k), [{"run_id": r, "event_id": n, "ts": at(86400 * d), "line": f"Epoch {e}/9"} for r, n, d, e in day])
    stream = logs.latest_progress_stream(lines(spark, arrivals), "10 days")
    query = start_to_folder(stream, out, str(tmp_path / "checkpoint"), "update")
    query.awaitTermination()
    latest = newest_rows(spark.read.parquet(out), ["run_id"], [F.col("ts"), F.col("line_no")])
    assert rows(latest, "run_id", "progress") == [("a", "2/9"), ("b", "7/9"), ("c", "3/9")]
    kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert kept[-1] < 4
