"""Every query of the core that has SQL, over the smallest tables, against DuckDB."""

import os

import pytest

from imaging_engine import registry
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert differs(spark, con, SF, name, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["agg01_series_rollup", "joi01_preserve_on_miss", "agg10_all_equal", "top01_suggestions", "p1_found", "p3_found"])
def test_plan_has_no_cross_join_and_no_row_by_row_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))


def test_scan_reads_the_columns_it_needs(spark):
    plan = registry.queries()["agg06_duplicate_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<series_uid:string,is_duplicate:boolean>" in plan
    plan = registry.queries()["joi05_still_to_check"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(hash)" in plan or "PushedFilters: [IsNotNull(accepted)" in plan
