"""Every registered query on real tables, next to its SQL where there is one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    rows, problem, _ = compare(spark, con, name, SF)
    assert problem is None
    assert rows > 0


def test_entry_has_a_stable_schema(spark):
    first, second = entry(spark), entry(spark)
    assert first.schema == second.schema
    assert first.count() == second.count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["anti_join_unexposed", "group_mean_ratio", "top1_smallest_per_group"])
def test_no_cross_join_in_plan(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
