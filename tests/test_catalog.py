"""Every registered query of the core against DuckDB."""

import pytest
from oracle import mismatch

from quern import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_equals_oracle(spark, name):
    assert mismatch(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) is None


def _plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_star_is_one_scan_with_pushdown(spark):
    plan = _plan(spark, "bgp_constant_object")
    assert plan.count("FileScan parquet") == 1 and "EqualTo(c_mktsegment,BUILDING)" in plan and "EqualTo(c_nationkey,3)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in plan


@pytest.mark.parametrize("name", ["bgp_join_chain", "optional_nested", "exists_theta_newer_event", "close_friends", "not_exists_lineitem", "minus_labels", "subselect_join"])
def test_no_nested_loop_and_no_python(spark, name):
    plan = _plan(spark, name)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan
