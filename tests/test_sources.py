"""Readers and writers."""

import gzip
import itertools
import json
import uuid
from datetime import UTC, datetime

import pytest
from helpers import jobs, rows
from pyspark.sql import functions as F

from runlens import sources
from runlens.operators.submissions import validate_submissions
from runlens.sources import readers, writers

A, B = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"
LINE = "job_id string, line_no bigint, line string"


def test_inventory_has_aliases_defaults_and_order(spark, tmp_path):
    path = tmp_path / "nodes.json"
    listed = [
        {"id": "z", "isForProfiling": True, "cost": 0.2, "workerUrl": "http://z", "resources": [{"gpu_type": "A", "gpu_count": 4}]},
        {"id": "a"},
        {"id": "d", "resources": [{"gpu_type": "A", "gpu_count": 1}, {"gpu_type": "A", "gpu_count": 2}]},
    ]
    path.write_text(json.dumps(listed, indent=2))
    found = sources.read_nodes(spark, str(path)).orderBy("node_pos").collect()
    assert [tuple(r)[:5] for r in found] == [
        ("z", 0, True, 0.2, "http://z"),
        ("a", 1, False, 0.0, None),
        ("d", 2, False, 0.0, None),
    ]
    assert [[tuple(g) for g in r["resources"]] for r in found] == [[("A", 4)], [], [("A", 2)]]


def test_missing_files_are_empty(spark, tmp_path):
    assert sources.read_nodes(spark, str(tmp_path / "no.json")).count() == 0
    assert sources.read_gpu_costs(spark, str(tmp_path / "no.json")).count() == 0


def test_costs_become_a_long_table(spark, tmp_path):
    path = tmp_path / "costs.json"
    path.write_text(json.dumps({"A40": {"1": 0.15, "4": 0.54}, "L40S": {"2": 0.34}}, indent=1))
    assert rows(sources.read_gpu_costs(spark, str(path))) == [("A40", 1, 0.15), ("A40", 4, 0.54), ("L40S", 2, 0.34)]


def test_jobs_round_trip_with_defaults(spark, tmp_path):
    path = str(tmp_path / "jobs")
    sources.append_rows(jobs(spark, {"id": "a", "assigned_gpu_config": {"L": 1, "A": 2}}).drop("config_key"), path)
    sources.append_rows(jobs(spark, {"id": "b", "priority": 5}).drop("config_key"), path)
    found = rows(sources.read_jobs(spark, path), "id", "priority", "epochs_total", "profiling_epochs_no", "config_key")
    assert found == [("a", 3, 20, 3, '{"A":2,"L":1}'), ("b", 5, 20, 3, None)]


def test_submissions(spark, tmp_path):
    path = tmp_path / "posted.json"
    posted = [
        {"job_id": "t", "dockerImage": "i", "scriptPath": "s.py", "Priority": 2, "epochsTotal": 9},
        {"job_id": "u", "dockerImage": "i", "deadline": "2026-01-01T01:00:00+05:00"},
        {"job_id": "v", "dockerImage": "i", "deadline": "2025-12-31T23:00:00-05:00"},
    ]
    path.write_text("\n".join(map(json.dumps, posted)))
    frame = sources.read_submissions(spark, str(path))
    assert rows(frame, "job_id", "script_path", "priority", "epochs_total")[0] == ("t", "s.py", 2, 9)
    # The zone of a deadline is dropped, not converted.
    checked = validate_submissions(frame, F.lit(datetime(2026, 1, 1, tzinfo=UTC)))
    assert rows(checked, "job_id", "is_valid") == [("t", True), ("u", True), ("v", False)]
    assert frame.where("job_id = 'u'").first()["deadline"].timestamp() == datetime(2025, 12, 31, 20, tzinfo=UTC).timestamp()


def write_logs(folder):
    for name, text in ((A, "one\ntwo\n\nfour\n"), (B, "x" * 50), ("not-a-uuid", "no\n")):
        (folder / name).mkdir(parents=True)
        (folder / name / "output.log").write_text(text)


def test_run_logs(spark, tmp_path):
    write_logs(tmp_path)
    paths = f"{tmp_path}/*/output.log"
    everything = [(A, 1, "one"), (A, 2, "two"), (A, 3, ""), (A, 4, "four"), (B, 1, "x" * 50)]
    assert rows(sources.read_run_logs(spark, paths)) == everything
    assert rows(sources.read_run_logs(spark, paths, max_bytes=None)) == everything
    assert rows(sources.read_run_logs(spark, paths, max_bytes=20)) == everything[:4]
    assert rows(sources.read_run_logs(spark, paths, jobs=jobs(spark, {"id": B}))) == everything[4:]


def test_large_logs_are_numbered_across_splits(spark, tmp_path):
    folder = tmp_path / A
    folder.mkdir()
    (folder / "output.log").write_text("".join(f"line {n}\n" for n in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = sources.read_run_logs(spark, f"{tmp_path}/*/output.log", jobs=jobs(spark, {"id": A}), max_bytes=None)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
        assert lines.where("line <> concat('line ', line_no)").count() == 0 and lines.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_log_sink_appends_in_order(spark, tmp_path):
    path = str(tmp_path / "logs")
    for start in (0, 100):
        lines = spark.range(start, start + 100).select(
            F.when(F.col("id") % 2 == 0, A).otherwise(B).alias("job_id"),
            (F.col("id") + 1).alias("line_no"),
            F.concat(F.lit("Epoch "), "id", F.lit("/200")).alias("line"),
        )
        sources.write_run_logs(lines.repartition(4), path)
    back = {(r["job_id"], r["line_no"], r["line"]) for r in sources.read_run_logs(spark, path).collect()}
    assert back == {(A if n % 2 == 0 else B, n // 2 + 1, f"Epoch {n}/200") for n in range(200)}


def test_appends_and_chunks_keep_their_order(spark, tmp_path):
    """Appends that number their lines anew come one after the other, and chunks in the order of their lines."""
    path = str(tmp_path / "logs")
    for append, name in enumerate("ab"):
        lines = spark.range(250).select(
            F.lit(A).alias("job_id"), (F.col("id") + 1).alias("line_no"), F.concat(F.lit(name), "id").alias("line")
        )
        sources.write_run_logs(lines.repartition(7), path, append=append, chunk=40)
    back = [r["line"] for r in sources.read_run_logs(spark, path).orderBy("line_no").collect()]
    assert back == [f"{name}{n}" for name in "ab" for n in range(250)]


def test_no_log_is_refused_in_silence(spark, tmp_path):
    """The limit counts all files of a log, and what is above it is named."""
    path = str(tmp_path / "logs")
    for append in range(3):
        lines = spark.createDataFrame([(A, 1, "x" * 30), (B, 1, "y")], "job_id string, line_no bigint, line string")
        sources.write_run_logs(lines, path, append=append)
    (tmp_path / "logs" / f"job_id={B}" / "notes.txt").write_text("no log")
    assert sources.read_run_logs(spark, path).count() == 6
    assert rows(sources.refused_logs(spark, path, 60)) == [(A, 93)]
    assert rows(sources.read_run_logs(spark, path, max_bytes=60)) == [(B, n, "y") for n in (1, 2, 3)]
    assert rows(sources.log_sizes(spark, path)) == [(A, 93), (B, 6)]


def most_tasks(spark, run):
    """The most tasks of a stage that ``run`` starts, and what it gives."""
    context = spark.sparkContext
    context.setJobGroup(group := uuid.uuid4().hex, "test")
    given = run()
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s), given


def many_logs(spark, path):
    ids = [F.substring(F.md5(F.col("id").cast("string")), at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    lines = spark.range(2000).withColumn("id", F.col("id") % 1000)
    lines = lines.select(F.concat_ws("-", *ids).alias("job_id"), F.lit(1).cast("bigint").alias("line_no"), F.lit("ü").alias("line"))
    for append in range(2):
        sources.write_run_logs(lines, path, append)


def test_a_log_of_many_costs_one_file_an_append(spark, tmp_path):
    """No checksum file beside it, which cost three processes each. Logs are listed and read by few tasks."""
    path = str(tmp_path / "logs")
    many_logs(spark, path)
    assert len(list(tmp_path.rglob("part-*"))) == 2000 and not list(tmp_path.rglob(".part-*"))
    assert [f.name for f in (tmp_path / "logs").iterdir() if not f.name.startswith("job_id=")] == ["_SUCCESS"]
    tasks, read = most_tasks(spark, lambda: sources.read_run_logs(spark, path).groupBy("line_no", "line").count().collect())
    assert tasks <= 16 * spark.sparkContext.defaultParallelism < 1000
    assert sorted(map(tuple, read)) == [(n, "ü", 1000) for n in (1, 2, 3, 4)]


def test_sizes_of_many_logs_are_few_tasks(spark, tmp_path):
    path = str(tmp_path / "logs")
    many_logs(spark, path)
    tasks, refused = most_tasks(spark, lambda: sources.refused_logs(spark, path, 11).groupBy("bytes").count().collect())
    assert tasks <= 16 * spark.sparkContext.defaultParallelism < 1000
    assert list(map(tuple, refused)) == [(12, 1000)]
    tasks, kept = most_tasks(spark, lambda: sources.read_run_logs(spark, path, max_bytes=11).collect())
    assert tasks <= 16 * spark.sparkContext.defaultParallelism and kept == []


def test_sinks_write_the_same_folders(spark, tmp_path, monkeypatch):
    """Written by tasks or by Spark's writer, odd ids, NULLs and bytes that are no text included. A second write adds to them."""
    odd = [None, "", "a/b=c", "x y%{z}^", "ü", *map(chr, range(1, 32)), A]
    lines = spark.createDataFrame([(j, n, None if n == 3 else f"{n}") for j in odd for n in range(5)], LINE)
    lines = lines.union(spark.range(1).selectExpr(f"'{B}'", "7L", "CAST(X'66FF0A80' AS STRING)"))
    for name, mounted in (("tasks", writers.mounted_path), ("spark", lambda *_: None)):
        monkeypatch.setattr(writers, "mounted_path", mounted)
        for append in (0, 0, 1):
            sources.write_run_logs(lines.repartition(3), f"file://{tmp_path}/{name}", append, chunk=2)
    written = []
    for name in ("tasks", "spark"):
        files = sorted((str(f.parent.relative_to(tmp_path / name)), f.read_bytes()) for f in (tmp_path / name).rglob("part-*"))
        # NULL and "" are one folder, and may be one file or two there.
        written.append([(folder, b"".join(c for _, c in group)) for folder, group in itertools.groupby(files, key=lambda f: f[0])])
    assert written[0] == written[1] and len(written[0]) == 2 * (3 * (len(odd) - 1) + 1)


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "logs")
    lines = spark.range(100).selectExpr(f"'{A}' AS job_id", "id AS line_no", "IF(id = 99, raise_error('no'), 'x') AS line")
    with pytest.raises(Exception, match="no"):
        sources.write_run_logs(lines, path, 0, chunk=10)
    assert list((tmp_path / "logs").iterdir()) == []


BYTES = [b"", b"\n", b"a", b"a\n\n", b"a\r\nb\rc\n\rd", b"\xef\xbb\xbfa\n\xef\xbb\xbfb", b"\xef\xbb\xbf", b"\xff\xfe\n\xc3", "ü\u2028\x85x\n".encode()]


@pytest.mark.parametrize("whole", (0, 4, 1 << 20))
def test_files_read_whole_and_by_lines_agree(spark, tmp_path, monkeypatch, whole):
    """Every kind of line end, with files of a log read as one value, by lines, and some of them packed."""
    monkeypatch.setattr(readers, "WHOLE_FILE", whole)
    (tmp_path / A).mkdir()
    for n, content in enumerate(BYTES):
        (tmp_path / A / f"part-{n}.txt").write_bytes(content)
        (tmp_path / A / f"part-{n}.txt.gz").write_bytes(gzip.compress(content))
    files = sorted((tmp_path / A).iterdir())
    expected = [bytes(r[0]) for f in files for r in spark.read.text(str(f)).selectExpr("CAST(value AS BINARY)").collect()]
    found = sources.read_run_logs(spark, str(tmp_path)).selectExpr("line_no", "CAST(line AS BINARY)")
    assert [(n, bytes(v)) for n, v in sorted(map(tuple, found.collect()))] == [*enumerate(expected, 1)]
    size = sum(f.stat().st_size for f in files)
    assert sources.read_run_logs(spark, str(tmp_path), max_bytes=size).count() == len(expected)
    assert sources.read_run_logs(spark, str(tmp_path), max_bytes=size - 1).count() == 0


def test_a_log_in_two_places_is_one(spark, tmp_path):
    """Files of the same name below two folders of the same job: every line once."""
    for root in "xy":
        (tmp_path / root / A).mkdir(parents=True)
        (tmp_path / root / A / "output.log").write_text(f"{root}1\n{root}2\n")
    assert rows(sources.read_run_logs(spark, str(tmp_path))) == [(A, 1, "x1"), (A, 2, "x2"), (A, 3, "y1"), (A, 4, "y2")]


def test_large_files_are_numbered_across_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "WHOLE_FILE", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        for append, lines in enumerate((20, 20_000, 30)):
            frame = spark.range(lines).selectExpr(f"'{A}' AS job_id", "id AS line_no", f"concat('{append} ', id) AS line")
            sources.write_run_logs(frame, str(tmp_path), append)
        found = sources.read_run_logs(spark, str(tmp_path), jobs=jobs(spark, {"id": A})).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in found] == [f"{a} {n}" for a, lines in enumerate((20, 20_000, 30)) for n in range(lines)]
    assert [r["line_no"] for r in found] == [*range(1, 20_051)]


def test_wrong_types_are_errors(spark, tmp_path):
    path = tmp_path / "posted.json"
    base = {"job_id": "t", "dockerImage": "i"}
    cases = [
        ({"deadline": "tomorrow"}, ["deadline has the wrong type"]),
        ({"Priority": "high"}, ["priority has the wrong type"]),
        ({"Priority": 4.5}, ["priority has the wrong type"]),
        ({"Priority": 4.0}, []),
        ({"Priority": 6}, ["priority out of range"]),
        ({"command": "python x"}, ["command has the wrong type"]),
        ({"command": ["python", "x"]}, []),
        ({"epochsTotal": 99999999999}, ["epochs_total has the wrong type"]),
        ({"epochsTotal": 0}, ["epochs_total below 1"]),
        ({"job_id": None}, ["job_id is required"]),
    ]
    path.write_text("\n".join([*(json.dumps(base | c) for c, _ in cases), '{"job_id": "t"', "[]"]))
    checked = validate_submissions(sources.read_submissions(spark, str(path)), F.lit(datetime(2026, 1, 1, tzinfo=UTC)))
    found = [r["errors"] for r in checked.coalesce(1).collect()]
    assert found[: len(cases)] == [e for _, e in cases]
    assert found[len(cases)] == ["not a JSON object"]


def test_new_version_of_a_table(spark, tmp_path):
    table = jobs(spark, {"id": "a"})
    stored = sources.write_version(table, str(tmp_path / "v1"))
    assert stored.columns == table.columns and stored.count() == 1


def test_status_filters_reach_the_scan(spark, tmp_path):
    from runlens.operators.filters import waiting

    path = str(tmp_path / "jobs")
    sources.append_rows(jobs(spark, {"id": "a"}, {"id": "b", "status": "RUNNING"}).drop("config_key"), path)
    found = waiting(sources.read_jobs(spark, path)).select("id", "created_at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,QUEUED)" in plan and "IsNull(assigned_node)" in plan
    assert "ReadSchema: struct<id:string,status:string,created_at:timestamp,assigned_node:string>" in plan
    assert rows(found, "id") == [("a",)]

    split = str(tmp_path / "split")
    sources.append_rows(sources.read_jobs(spark, path).drop("config_key"), split, partition_by="status")
    plan = waiting(sources.read_jobs(spark, split))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
