"""Plan checks: no row-at-a-time Python, no cartesian or
nested-loop joins in any SQL-checked query; Arrow batches only where listed."""

import pytest

from loanbook.plans import catalog

catalog.load_all()
ARROW_ALLOWED = {"a9_metrics"}  # distributed running sums fold Arrow batches


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_plan_shape(spark, sf_small, name):
    plan = catalog.QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ARROW_ALLOWED:
        assert "MapInPandas" not in plan


def test_scan_pruning(spark, sf_small):
    plan = catalog.QUERIES["s2_route_parquet"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
