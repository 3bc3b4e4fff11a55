"""As-of, interval and session operators, table differences and levels of totals, against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.operators import capacity, changes, sketches, temporal
from runlens.plans.ordered import HotGroups

T0 = datetime(2026, 1, 1)
CUT = HotGroups(min_rows=20, max_groups=8, chunks=4)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("hot", [HotGroups(), CUT])
def test_as_of_equals_the_last_state(spark, hot):
    """A third of the rows on one key, states of one moment, keys and times that are NULL."""
    rng = random.Random(2)
    keys = ["hot"] * 5 + ["a", "b", "c", None]
    states = [(rng.choice(keys), at(rng.randrange(60)), n, rng.choice(["x", "y", None])) for n in range(150)]
    lines = [(rng.choice([*keys, "none"]), at(rng.randrange(-5, 70)) if n % 20 else None, n) for n in range(300)]
    found = temporal.as_of(
        spark.createDataFrame(lines, "k string, t timestamp, n int"),
        spark.createDataFrame([*states, (None, None, 9, "z")], "k string, since timestamp, n int, status string"),
        ["k"], "t", ["status"], tie=["n"], hot=hot,
    )
    expected = {}
    for k, t, n in lines:
        before = [(s, m, v) for sk, s, m, v in states if sk == k is not None and t is not None and s <= t]
        expected[n] = max(before)[2] if before else None
    assert found.columns == ["k", "t", "n", "status"]
    assert {r["n"]: r["status"] for r in found.collect()} == expected


@pytest.mark.parametrize("base", [60, 3600, 100_000_000])
def test_overlaps_equal_all_pairs(spark, base):
    rng = random.Random(3)

    def intervals(n, first):
        return [(rng.choice(["hot", "hot", "b", None]), first + i, at(s := rng.randrange(-400, 4000)), at(s + rng.choice([-3, 0, 1, 7, 60, 900, 100_000]))) for i in range(n)]

    left, right = [*intervals(120, 0), ("b", 999, None, at(3))], intervals(80, 1000)
    found = temporal.overlapping(
        spark.createDataFrame(left, "k string, l int, start timestamp, end timestamp"),
        spark.createDataFrame(right, "k string, r int, start timestamp, end timestamp"),
        ["k"], base,
    )
    expected = Counter()
    for k, i, s, e in left:
        for k2, j, s2, e2 in right:
            if k == k2 is not None and s is not None and s < e and s2 < e2 and s < e2 and s2 < e:
                expected[k, i, j, max(s, s2), min(e, e2)] += 1
    assert Counter((r["k"], r["l"], r["r"], r["from"], r["to"]) for r in found.collect()) == expected and expected


def test_a_long_interval_takes_few_buckets(spark):
    long = spark.createDataFrame([("a", at(0), at(60 * 24 * 365))], "k string, start timestamp, end timestamp")
    rows = temporal._bucketed(temporal._levelled(long, 3600 * 1_000_000), [0, 3, 7, 14, 15], 3600 * 1_000_000)
    assert 1 <= rows.count() <= 3 * 3


def test_overlaps_join_by_equality(spark):
    one = spark.createDataFrame([("a", 1, at(0), at(5))], "k string, l int, start timestamp, end timestamp")
    plan = temporal.overlapping(one, one.withColumnRenamed("l", "r"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("hot", [HotGroups(), CUT])
def test_peaks_equal_a_count_per_moment(spark, hot):
    rng = random.Random(4)
    runs = [(rng.choice(["hot", "hot", "n2"]), at(s := rng.randrange(300)), at(s + rng.choice([0, 1, 5, 80])), rng.randrange(1, 5)) for _ in range(200)]
    found = temporal.peak_use(spark.createDataFrame(runs, "node string, start timestamp, end timestamp, n int"), ["node"], "n", hot)
    for r in found.collect():
        used = {m: sum(n for k, s, e, n in runs if k == r["node"] and s <= at(m) < e) for m in range(300)}
        assert r["peak"] == max(used.values()) and r["peak_at"] == at(min(m for m, u in used.items() if u == r["peak"]))
    assert found.count() == 2


def test_sessions_and_stalls(spark):
    lines = [("a", at(m)) for m in (0, 3, 9, 19, 30, 41)] + [("b", at(5)), ("b", None), (None, at(1))]
    frame = spark.createDataFrame(lines, "run string, t timestamp")
    found = temporal.sessions(frame, ["run"], "t", "10 minutes")
    assert {tuple(r) for r in found.collect()} == {("a", at(0), at(19), 4), ("a", at(30), at(30), 1), ("a", at(41), at(41), 1), ("b", at(5), at(5), 1), (None, at(1), at(1), 1)}
    silent = temporal.stalls(found, ["run"])
    assert {tuple(r) for r in silent.collect()} == {("a", at(19), at(30), 1), ("a", at(30), at(41), 2)}
    assert temporal.stalls(temporal.sessions(frame.limit(0), ["run"], "t", "1 minute"), ["run"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_applied_differences_give_the_other_version(spark, seed):
    rng = random.Random(seed)

    def version():
        return [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice(["x", None])) for _ in range(rng.choice([0, 5, 60]))]

    a, b = version(), version()
    old, new = (spark.createDataFrame(v, "id string, n int, s string") for v in (a, b))
    diff = changes.table_diff(old, new)
    found = Counter()
    for r in diff.collect():
        found[tuple(r)[2:]] += r["copies"] * (1 if r["change"] == "added" else -1)
    counts = Counter(b)
    counts.subtract(Counter(a))
    assert found == Counter({k: n for k, n in counts.items() if n})
    assert Counter(map(tuple, changes.apply_diff(old, diff).collect())) == Counter(b)


def test_columns_that_changed(spark):
    a = [("k1", 1, "x"), ("k2", 2, None), ("k3", 3, "z"), (None, 4, "n"), ("k5", 5, "d"), ("k5", 5, "d")]
    b = [("k1", 1, "x"), ("k2", 7, "y"), ("k4", 3, "z"), (None, 4, None), ("k5", 6, "d")]
    diff = changes.table_diff(*(spark.createDataFrame(v, "id string, n int, s string") for v in (a, b)))
    found = {tuple(r) for r in changes.column_changes(diff, ["id"]).collect()}
    assert found == {("k2", "n", "2", "7"), ("k2", "s", None, "y"), (None, "s", "n", None)}


def test_totals_are_told_from_nulls(spark):
    rows = [("n1", {"A": 2, "B": 1}, "RUNNING"), ("n1", {"A": 1}, None), ("n2", {"B": 4}, "RUNNING"), (None, {"A": 9}, "RUNNING"), ("n3", None, "RUNNING")]
    jobs = spark.createDataFrame(rows, "assigned_node string, assigned_gpu_config map<string,int>, status string")
    rolled = capacity.usage_rollup(jobs)
    found = {tuple(r)[:4]: tuple(r)[4:] for r in rolled.collect()}
    assert found[(None, None, None, 7)] == (8, 4)
    assert found[("n1", "A", None, 0)] == (1, 1) and found[("n1", "A", None, 1)] == (3, 2)
    assert found[(None, None, None, 6)] == (1, 1) and found[(None, None, "RUNNING", 6)] == (7, 3)
    plan = rolled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Join") == 0


@pytest.mark.parametrize("hot", [HotGroups(), CUT])
def test_rolling_equals_the_plain_window(spark, hot):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 6 + ["b", None]), i, at(rng.randrange(400)) if i % 30 else None, rng.randrange(100)) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, i int, t timestamp, v int")
    found = temporal.rolling(frame, ["k"], "t", 1800, {"n": F.count(F.lit(1)), "most": F.max("v"), "total": F.sum("v")}, hot)
    for r in found.collect():
        near = [v for k, _, t, v in rows if k == r["k"] and (t is r["t"] is None or t and r["t"] and r["t"] - timedelta(minutes=30) <= t <= r["t"])]
        assert (r["n"], r["most"], r["total"]) == (len(near), max(near), sum(near))
    assert found.count() == 300


def test_a_hot_group_rolls_in_many_tasks(spark):
    rows = spark.range(2000).selectExpr("'hot' AS k", "timestamp_seconds(id * 60) AS t", "id AS v")
    found = temporal.rolling(rows, ["k"], "t", 600, {"n": F.count(F.lit(1))}, HotGroups(min_rows=100, max_groups=4, chunks=16))
    assert found.where("v >= 10 AND n <> 11").count() == 0 and found.count() == 2000


def test_merged_sketches_keep_to_their_error(spark):
    rows = spark.range(200_000).selectExpr("id % 3 AS k", "timestamp_seconds(id * 60) AS t", "pow(id % 9973, 1.5) AS v", "concat('r', id % 20011) AS run")
    daily = sketches.daily_sketches(rows, ["k"], "t", "v", "run")
    whole = sketches.estimates(sketches.merged(daily, ["k"]), ["k"], 0.95).collect()
    at_once = {r["k"]: r for r in sketches.estimates(sketches.daily_sketches(rows.withColumn("t", F.lit(T0)), ["k"], "t", "v", "run"), ["k"], 0.95).collect()}
    for r in whole:
        own = rows.where(F.col("k") == r["k"])
        rank = own.where(F.col("v") <= r["quantile_value"]).count() / r["n"]
        distinct = own.select("run").distinct().count()
        assert abs(rank - 0.95) <= sketches.RANK_ERROR and abs(r["n_distinct"] - distinct) <= sketches.COUNT_ERROR * distinct
        assert r["n_distinct"] == pytest.approx(at_once[r["k"]]["n_distinct"], rel=0.01) and r["n"] == at_once[r["k"]]["n"]
