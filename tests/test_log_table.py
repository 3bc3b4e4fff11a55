"""Logs as one table with a manifest, and inventories by lines."""

import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from runlens import sources
from runlens.plans.ordered import HotGroups

A, B = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"
LINE = "job_id string, line_no bigint, line string"


def files_read(frame):
    """How many files a scan of lines opens when the frame runs."""
    frame.count()
    frame, counts = frame.select("*"), []

    def visit(plan):
        if plan.nodeName().startswith("Scan parquet") and "line" in plan.schema().simpleString():
            counts.append(plan.metrics().get("numFiles").get().value())
        for i in range(plan.children().size()):
            visit(plan.children().apply(i))

    frame.collect()
    visit(frame._jdf.queryExecution().executedPlan())
    return sum(counts)


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_jobs_lie_in_few_files(spark, tmp_path, plain_plans):
    """100,000 jobs: a few hundred files, and three jobs open three buckets of each append."""
    path = str(tmp_path / "logs")
    for append in range(2):
        lines = spark.range(100_000).selectExpr("concat('job-', id) AS job_id", "1L AS line_no", "concat('Epoch ', id) AS line")
        sources.append_log_table(lines, path, append, buckets=64)
    assert len(list((tmp_path / "logs" / "lines").rglob("part-*.parquet"))) <= 2 * 64
    wanted = spark.createDataFrame([("job-7",), ("job-70000",), ("job-99999",), ("unknown",)], "id string")
    found = sources.read_log_table(spark, path, wanted)
    assert rows(found) == [(j, n, f"Epoch {j[4:]}") for j in ("job-7", "job-70000", "job-99999") for n in (1, 2)]
    assert 0 < files_read(found) <= 2 * 3
    assert sources.read_log_table(spark, path).count() == 200_000


def test_appends_keep_their_order_and_replace_a_failed_try(spark, tmp_path):
    path = str(tmp_path / "logs")
    parts = [[(A, 9, "a9"), (A, 2, "a2"), (B, 1, None)], [(A, 1, "b1"), (None, 1, "nobody's")], [(A, 1, "c1"), (A, 1, "c1"), (B, 5, "")]]
    for append in (1, 0, 2, 1):
        shown = spark.createDataFrame(parts[append], LINE).withColumn("bucket", F.lit("clash")).withColumn("n", F.lit(-1))
        sources.append_log_table(shown.repartition(3), path, append, buckets=4)
    expected = [(A, n, line) for n, line in enumerate(["a2", "a9", "b1", "c1", "c1"], 1)] + [(B, 1, ""), (B, 2, "")]
    assert rows(sources.read_log_table(spark, path)) == expected
    sources.compact_log_table(spark, path, str(tmp_path / "new"), buckets=2)
    assert rows(sources.read_log_table(spark, str(tmp_path / "new"))) == expected
    # An append that was cut off before its manifest does not count.
    (tmp_path / "logs" / "manifest" / "append=2").rename(tmp_path / "unfinished")
    assert rows(sources.read_log_table(spark, path)) == [(A, 1, "a2"), (A, 2, "a9"), (A, 3, "b1"), (B, 1, "")]


def test_sizes_and_limits_come_from_the_manifest(spark, tmp_path):
    path = str(tmp_path / "logs")
    for append in range(3):
        sources.append_log_table(spark.createDataFrame([(A, 1, "ü" * 15), (B, 1, "y")], LINE), path, append)
    assert rows(sources.log_table_sizes(spark, path)) == [(A, 93), (B, 6)]
    assert rows(sources.refused_in_table(spark, path, 60)) == [(A, 93)]
    assert rows(sources.read_log_table(spark, path, max_bytes=60)) == [(B, n, "y") for n in (1, 2, 3)]
    assert not any("lines/" in f for f in sources.log_table_sizes(spark, path).inputFiles())


def test_a_hot_log_is_written_by_several_tasks(spark, tmp_path, plain_plans):
    path = str(tmp_path / "logs")
    lines = spark.range(3_000).select(F.lit(A).alias("job_id"), "id", F.concat(F.lit("line "), "id").alias("line"))
    sources.append_log_table(lines.withColumnRenamed("id", "line_no"), path, 0, chunk=250, hot=HotGroups(min_rows=500))
    assert len(list((tmp_path / "logs" / "lines").rglob("part-*.parquet"))) > 1
    found = sources.read_log_table(spark, path)
    assert found.where("line = concat('line ', line_no - 1)").count() == found.count() == 3_000


def test_no_table_and_an_empty_one(spark, tmp_path):
    path = str(tmp_path / "logs")
    for _ in range(2):
        assert sources.read_log_table(spark, path).count() == 0
        assert sources.read_log_table(spark, path, spark.createDataFrame([(A,)], "id string"), 5).count() == 0
        assert sources.log_table_sizes(spark, path).count() == 0
        sources.append_log_table(spark.createDataFrame([], LINE), path, 0)


def test_inventory_by_lines(spark, tmp_path):
    listed = [
        {"id": "z", "position": 1, "isForProfiling": True, "cost": 0.2, "resources": [{"gpu_type": "A", "gpu_count": 4}]},
        {"id": "a", "position": 0, "resources": [{"gpu_type": "A", "gpu_count": 1}, {"gpu_type": "A", "gpu_count": 2}]},
    ]
    path = tmp_path / "nodes.jsonl"
    path.write_text("\n".join([*map(json.dumps, listed), "", "no json", '{"id": "cut"']))
    found = sources.read_node_lines(spark, str(path)).orderBy("node_pos").collect()
    assert [(r["node_id"], r["node_pos"], r["is_for_profiling"], r["cost"]) for r in found] == [("a", 0, False, 0.0), ("z", 1, True, 0.2)]
    assert [[tuple(g) for g in r["resources"]] for r in found] == [[("A", 2)], [("A", 4)]]
    path.write_text("\n".join(json.dumps({"id": name}) for name in "cab"))
    assert [r["node_id"] for r in sources.read_node_lines(spark, str(path)).orderBy("node_pos").collect()] == list("cab")
