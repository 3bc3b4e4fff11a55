"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from oracle_check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from runlens.oracle import ORACLES
from runlens.registry import QUERIES

SF = "/root/testdata/sf0.001"
SQL = ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert QUERIES.items() <= queries().items() and SQL.items() <= oracle_sql().items()


def test_entry(spark):
    assert entry(spark).count() == 259


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert differences(duck, QUERIES[name](spark, SF), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_product_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "MapInArrow"):
        assert operator not in plan
    assert "SELECT *" not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = QUERIES["status_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
