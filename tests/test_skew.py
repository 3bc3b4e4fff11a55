"""Hot groups are cut and spread without changing any result."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import lifecycle, runs
from runlens.plans import ordered
from runlens.plans.ordered import (
    HotGroups,
    cut_hot_groups,
    first_by,
    join_unique,
    previous,
    row_number,
    running_max,
    running_sum,
    with_ordered,
)
from runlens.plans.placement import plan_round

CUT = HotGroups(min_rows=20, max_groups=3, chunks=5)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key, and the NULL key, hold a third of the rows each."""
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = rng.choice(["hot", None, f"k{rng.randrange(40)}"])
        at = None if rng.random() < 0.02 else rng.randrange(60)
        data.append((i, key, at, rng.choice([None, rng.randrange(100)])))
    return spark.createDataFrame(data, "id int, key string, at int, v int").repartition(5).cache()


@pytest.mark.parametrize("hot", [CUT, HotGroups(), HotGroups(min_rows=1, max_groups=100, chunks=2)])
def test_ordered_columns_equal_plain_windows(skewed, hot):
    columns = {
        "n": row_number(),
        "before": previous("v"),
        "top": running_max("v"),
        "total": running_sum("v"),
    }
    order = Window.partitionBy("key").orderBy("at", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.select(
        "id",
        F.row_number().over(order).cast("bigint").alias("n"),
        F.lag("v").over(order).alias("before"),
        F.max("v").over(so_far).alias("top"),
        F.sum("v").over(so_far).alias("total"),
    )
    ours = with_ordered(skewed, ["key"], ["at", "id"], columns, hot).select("id", *columns)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_hot_groups_are_cut_evenly(skewed):
    cut = cut_hot_groups(skewed, ["key"], ["at", "id"], CUT)
    sizes = {(r["key"], r["_chunk"]): r["count"] for r in cut.groupBy("key", "_chunk").count().collect()}
    chunks = [n for (key, _), n in sizes.items() if key == "hot"]
    assert len(chunks) == 5 and max(chunks) < 2 * sum(chunks) / 5
    assert all(chunk == 0 for (key, chunk) in sizes if key not in ("hot", None))


def test_a_hot_group_with_one_time_is_cut_too(spark):
    tied = spark.range(600).select("id", F.lit("k").alias("key"), F.lit(7).alias("at"))
    cut = cut_hot_groups(tied, ["key"], ["at", "id"], CUT)
    assert sorted(r["count"] for r in cut.groupBy("_chunk").count().collect()) == [120] * 5
    found = with_ordered(tied, ["key"], ["at", "id"], {"n": row_number(), "before": previous("id")}, CUT)
    assert found.where("n <> id + 1 OR before <> id - 1 OR (before IS NULL AND id > 0)").count() == 0


def test_cuts_of_a_wider_group_serve_the_groups_in_it(skewed):
    halves = skewed.withColumn("half", F.col("id") % 2)
    ours = with_ordered(
        halves, ["key", "half"], ["at", "id"], {"n": row_number()}, CUT, cut_by=(skewed, ["key"])
    ).select("id", "n")
    order = Window.partitionBy("key", "half").orderBy("at", "id")
    plain = halves.select("id", F.row_number().over(order).cast("bigint").alias("n"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("hot", [CUT, HotGroups()])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_unique_equals_a_plain_join(spark, skewed, hot, how):
    partners = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None), ("unused", 3)], "key string, x int")
    ours = join_unique(skewed, partners, ["key"], hot, how).select("id", "key", "x")
    plain = skewed.join(partners, "key", how).select("id", "key", "x")
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, plain.collect()))


def test_join_unique_spreads_a_hot_key(spark, skewed):
    joined = join_unique(skewed, spark.createDataFrame([("hot", 1)], "key string, x int"), ["key"], CUT)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(key" in text and "_part" in text


def test_first_by_equals_a_plain_window(skewed):
    ours = first_by(skewed, ["key"], [F.col("at"), F.col("id")])
    order = Window.partitionBy("key").orderBy("at", "id")
    plain = skewed.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    assert sorted(map(repr, ours.select("key", "id", "at", "v").collect())) == sorted(
        map(repr, plain.select("key", "id", "at", "v").collect())
    )


def test_operators_agree_whether_groups_are_cut_or_not(spark):
    rng = random.Random(3)
    now = datetime(2026, 1, 1, tzinfo=UTC)
    marks = spark.createDataFrame(
        [(rng.choice(["a", "a", "b"]), i, rng.randrange(9), datetime.fromtimestamp(rng.randrange(99), UTC)) for i in range(200)],
        "run_id string, line_no long, epoch long, ts timestamp",
    )
    cut, whole = (sorted(map(tuple, runs.epoch_intervals(marks, h).collect())) for h in (CUT, HotGroups()))
    assert cut == whole
    jobs = spark.createDataFrame([("a", s) for s in ["FAILED"]] + [("b", "RUNNING")], "id string, status string")
    sent = spark.createDataFrame(
        [(rng.choice(["a", "a", "b", "c"]), i, rng.choice(["stop", "resume"])) for i in range(200)],
        "id string, seq long, cmd string",
    )
    cut, whole = (sorted(map(repr, lifecycle.apply_commands(jobs, sent, h).collect())) for h in (CUT, HotGroups()))
    assert cut == whole
    assert now


def test_commands_equal_a_fold(spark):
    rng = random.Random(11)
    states = {f"j{i}": s for i, s in enumerate(["QUEUED", "RUNNING", "PROFILING", "FAILED", "PREEMPTED", "SUCCEEDED"])}
    sent = [(f"j{rng.randrange(7)}", i, rng.choice(["stop", "stop", "resume"])) for i in range(300)]
    expected, state = {}, dict(states)
    for job, seq, cmd in sent:
        now = state.get(job)
        if now is None:
            expected[seq] = (None, "not_found")
        elif cmd == "stop" and now in ("QUEUED", "RUNNING", "PROFILING"):
            expected[seq] = (now, "stopped" if now == "QUEUED" else "stop_requested")
            state[job] = "PREEMPTED"
        elif cmd == "resume" and now in ("PREEMPTED", "FAILED"):
            expected[seq] = (now, "resume_requested")
            state[job] = "QUEUED"
        else:
            expected[seq] = (now, "conflict")
    jobs = spark.createDataFrame(list(states.items()), "id string, status string")
    frame = spark.createDataFrame(sent, "id string, seq long, cmd string")
    for hot in (CUT, HotGroups()):
        found = lifecycle.apply_commands(jobs, frame, hot).collect()
        assert {r["seq"]: (r["status_before"], r["outcome"]) for r in found} == expected


def test_plan_round_with_hot_types(spark):
    from runlens import fixtures as fx

    sf = "/root/testdata/sf0.001"
    tables = fx.jobs(spark, sf), fx.claims(spark, sf), fx.nodes(spark, sf)
    cut = plan_round(*tables, hot=HotGroups(min_rows=5, max_groups=10, chunks=4)).collect()
    whole = plan_round(*tables).collect()
    assert sorted(map(repr, cut)) == sorted(map(repr, whole)) and len(whole) == 259


def test_many_hot_groups_are_all_cut(spark):
    """5,000 hot groups: none is left whole, and the number of their chunks follows their rows."""
    rows = spark.range(200_000).select("id", (F.col("id") % 5_000).alias("key"), F.xxhash64("id").alias("at"))
    cut = cut_hot_groups(rows, ["key"], ["at", "id"], HotGroups(min_rows=40))
    sizes = cut.groupBy("key", "_chunk").count().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most"))
    assert sizes.where("n = 4 AND most <= 12").count() == 5_000


def test_a_large_group_has_many_chunks(spark):
    """Hundreds of chunks in order and of like size, and the columns right."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 900).otherwise(-1).alias("key"), F.xxhash64("id").alias("at"))
    hot = HotGroups(min_rows=400)
    cut = cut_hot_groups(rows, ["key"], ["at", "id"], hot).where("key = -1")
    chunks = cut.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("_chunk").collect()
    assert len(chunks) == 400 and max(c["n"] for c in chunks) <= 300
    assert all(one["high"] < other["low"] for one, other in zip(chunks, chunks[1:]))
    order = Window.partitionBy("key").orderBy("at", "id")
    ours = with_ordered(rows, ["key"], ["at", "id"], {"n": row_number(), "before": previous("id")}, hot)
    plain = rows.select("*", F.row_number().over(order).cast("bigint").alias("n"), F.lag("id").over(order).alias("before"))
    assert ours.exceptAll(plain).count() == 0 and ours.count() == 60_000


def test_chunks_stay_within_their_bounds(spark, monkeypatch):
    """However many rows there are, a group has at most MAX_CHUNKS chunks, and all together about ALL_CHUNKS."""
    monkeypatch.setattr(ordered, "MAX_CHUNKS", 32)
    monkeypatch.setattr(ordered, "ALL_CHUNKS", 64)
    rows = spark.range(4_000).select(F.when(F.col("id") < 3_000, F.lit(0)).otherwise(F.col("id") % 5).alias("key"))
    found = {r["_k"]: r["_chunks"] for r in ordered.largest_groups(rows, ["key"], ["_k"], HotGroups(min_rows=4)).collect()}
    assert found == {0: 32, **dict.fromkeys(range(1, 5), 4)}
