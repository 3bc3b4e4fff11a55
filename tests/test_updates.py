"""Updates keep one row per job, pages do not overlap, durations round on the binary value."""

from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal

from helpers import NOW, claims, jobs, nodes, rows
from pyspark.sql import functions as F

from runlens.functions import format_duration
from runlens.operators import lifecycle, listing
from runlens.operators.capacity import gpu_usage, node_free
from runlens.operators.configs import available_config


def test_repeated_exits_and_changes_never_multiply_rows(spark):
    listed = jobs(spark, *[{"id": f"j{n}", "status": "RUNNING"} for n in range(20)])
    exits = spark.createDataFrame([(f"j{n}", n % 2) for n in range(20)] * 3 + [("j0", 1), ("j1", None)], "id string, exit_code int")
    ended = lifecycle.resolve_outcomes(listed, exits, F.lit(NOW))
    assert ended.count() == 20
    found = dict(rows(ended, "id", "status"))
    assert found["j0"] == found["j1"] == "FAILED" and found["j2"] == "SUCCEEDED"
    last = spark.createDataFrame([("j0", 1, 1), ("j0", 0, 2)], "id string, exit_code int, seq int")
    newest = lifecycle.resolve_outcomes(listed, last, F.lit(NOW), newest=[F.col("seq")])
    assert dict(rows(newest, "id", "status"))["j0"] == "SUCCEEDED"

    changes = spark.createDataFrame(
        [("j1", {"A": 1}, "1/9"), ("j1", {"A": 2}, "1/9"), ("j1", {"A": 2}, "1/9")],
        "id string, assigned_gpu_config map<string,int>, progress string",
    )
    patched = lifecycle.patch_jobs(listed, changes, F.lit(NOW))
    assert patched.count() == 20
    assert patched.where("id = 'j1'").first()["assigned_gpu_config"] == {"A": 2}


def test_unknown_commands_change_nothing(spark):
    listed = jobs(spark, {"id": "p", "status": "PREEMPTED"})
    sent = spark.createDataFrame([("p", 1, "pause"), ("p", 2, "resume"), ("p", 3, None)], "id string, seq int, cmd string")
    outcomes = lifecycle.apply_commands(listed, sent)
    assert {(r["seq"], r["outcome"], r["code"]) for r in outcomes.collect()} == {
        (1, "unknown_command", 400),
        (2, "resume_requested", 202),
        (3, "unknown_command", 400),
    }
    assert rows(lifecycle.commanded_jobs(listed, outcomes, F.lit(NOW)), "id", "status") == [("p", "QUEUED")]


def test_durations_round_on_the_binary_value(spark):
    values = [n / 10_000 for n in range(0, 600_000, 7)] + [0.015, 0.045, 0.125, 0.375, 59.995, 59.999]
    found = spark.createDataFrame([(v,) for v in values], "s double").select("s", format_duration("s").alias("d")).collect()
    for r in found:
        exact = Decimal(r["s"]).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert r["d"] == f"{exact}s"


def test_pages_are_disjoint_and_complete(spark):
    listed = jobs(spark, *[{"id": f"j{n:03}", "created_at": NOW + timedelta(seconds=n // 4)} for n in range(50)]).repartition(5)
    seen, after = [], None
    while page := listing.newest_page(listed, 7, after=after).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["created_at"], page[-1]["id"])
    whole = [r["id"] for r in listing.newest_page(listed, 100).collect()]
    assert seen == whole and len(set(seen)) == 50
    pages = [r["id"] for p in range(8) for r in listing.table_view(listed, page=p, page_size=7).collect()]
    assert pages == sorted(whole)


def test_results_have_one_order(spark):
    same = claims(spark, ("b", {"A": 1}, 5.0, "i"), ("a", {"A": 1}, 5.0, "i"), ("c", {"A": 1}, None, "i"), ("a", {"B": 1}, 4.0, "i"))
    found = [(r["job_id"], r["config_key"]) for r in listing.by_duration(same).collect()]
    assert found == [("a", '{"B":1}'), ("a", '{"A":1}'), ("b", '{"A":1}'), ("c", '{"A":1}')]


def test_standard_runs_on_many_gpu_types(spark):
    """Six types of eight GPUs have half a million configurations; only the measured one is fitted."""
    large = nodes(spark, ("n", False, {t: 8 for t in "ABCDEF"}))
    held = claims(spark, ("t", {"A": 2, "F": 8}, 3.0, "i"), ("t", {"A": 9}, 3.0, "i"), ("u", {"B": 1}, None, "i"))
    free = node_free(large, gpu_usage(jobs(spark, {"id": "x"})))
    types = spark.createDataFrame([("t",), ("u",)], "job_id string")
    assert rows(available_config(types, held, free)) == [("t", '{"A":2,"F":8}', "n"), ("u", None, None)]
