"""Open configurations by their gaps, against lists per type."""

import random
import re

import pytest
from helpers import claims, nodes
from pyspark.sql import functions as F

from runlens.operators import configs
from runlens.registry import QUERIES


def listed(valid, held):
    """{type: open configurations, smallest first}"""
    order = sorted(valid, key=lambda c: (c[1], c[0]))
    return {t: [c for c in order if c[0] not in own] for t, own in held.items()}


@pytest.mark.parametrize("seed", range(3))
def test_gaps_equal_lists(spark, seed):
    rng = random.Random(seed)
    node = nodes(spark, ("p", True, {"A": 3, "B": 2}), ("q", True, {"C": rng.randrange(1, 4)}))
    valid = configs.valid_configs(node)
    keys = [(r["config_key"], r["n_gpus"]) for r in valid.collect()]
    held = {f"t{k}": set(rng.sample([k for k, _ in keys], rng.choice([0, 1, 3, len(keys)]))) for k in range(12)}
    made = [(t, {"Z": 9}, None, "i") for t in held] + [(t, eval(k), 1.0, "i") for t, own in held.items() for k in own for _ in range(2)]
    made = claims(spark, *made, ("other", {"A": 1}, None, "i"))
    types = spark.createDataFrame([(t,) for t in held] * 2, "job_id string")
    expected = listed(keys, held)
    found = configs.unprofiled_configs(types, valid, made).collect()
    assert sorted((r["job_id"], r["n_gpus"], r["config_key"]) for r in found) == sorted((t, n, k) for t, own in expected.items() for k, n in own)
    first = {r["job_id"]: (r["config_key"], r["n_gpus"]) for r in configs.next_config(types, valid, made).collect()}
    assert first == {t: own[0] for t, own in expected.items() if own}

    fit = {k: rng.random() < 0.6 for k, _ in keys}
    placed = configs.rank_configs(valid).join(spark.createDataFrame([(k, "n" if f else None) for k, f in fit.items()], "config_key string, fit_node string"), "config_key")
    blocked = {r["job_id"]: (r["k"], r["k_config"]) for r in configs.blocked_places(types, placed, made, configs.claimed_places(made, placed)).collect()}
    at = {t: next((i for i, (k, _) in enumerate(own) if not fit[k]), None) for t, own in expected.items()}
    assert blocked == {t: (i, expected[t][i][0]) for t, i in at.items() if i is not None}


def test_no_configurations(spark):
    none = configs.valid_configs(nodes(spark, ("p", False, {"A": 1})))
    types = spark.createDataFrame([("t",)], "job_id string")
    for found in (configs.unprofiled_configs, configs.next_config, configs.config_grid):
        assert found(types, none, claims(spark)).collect() == []


def test_many_configurations_and_types(spark):
    """200,000 configurations and 1,000 types: what is sorted is what is claimed."""
    valid = spark.range(200_000).select(F.format_string("c%06d", "id").alias("config_key"), (F.col("id") % 40).cast("int").alias("n_gpus"))
    types = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("job_id"))
    made = spark.range(30_000).select(
        F.concat(F.lit("t"), F.col("id") % 1000).alias("job_id"),
        F.format_string("c%06d", (F.col("id") * F.lit(7919)) % 4000).alias("config_key"),
    )
    ranked = configs.rank_configs(valid)
    gaps = configs.open_gaps(types, ranked, configs.claimed_places(made, ranked))
    sizes = gaps.groupBy("job_id").agg(F.sum(F.col("next") - F.col("first")).alias("n"), F.count(F.lit(1)).alias("gaps"))
    claimed = made.distinct().groupBy("job_id").count().withColumnRenamed("count", "c")
    assert sizes.join(claimed, "job_id").where("n + c <> 200000 OR gaps > c + 1").count() == 0 and sizes.count() == 1000
    some = configs.open_places(gaps.withColumn("most", F.lit(50).cast("bigint"))).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"))
    assert some.where("n <> 50 OR r <> 49").count() == 0
    assert configs.next_config(types, valid, made).count() == 1000


@pytest.mark.parametrize("name", ["unprofiled_configs", "next_config", "config_grid", "plan_round"])
def test_no_list_of_configurations(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Lists of places to cut hot types at are bounded; lists of configurations are gone.
    assert not re.search(r"collect_list\((?!_at#)", plan)
