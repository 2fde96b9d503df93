"""Shapes the plans must keep: no nested loops, no single-partition window, pruned scans."""

import re

import pytest

import __spark_entry__ as contract
from poolwatch.queries import QUERIES as OWN

SF_DIR = "/root/testdata/sf0.001"
BATCH = {n: q for n, q in contract.queries().items() if n in OWN and not n.startswith("stream_")}


@pytest.mark.parametrize("name", list(BATCH))
def test_plan(spark, name):
    plan = BATCH[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    for window in re.findall(r"\n[^\n]*\bWindow [^\n]*", plan):
        assert not re.search(r"windowspecdefinition\((?!\w+#)", window), window


def test_scans_read_only_what_is_needed(spark):
    plan = contract.queries()["instance_load"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert "o_orderkey:bigint,o_custkey:bigint" in read and not any("o_totalprice" in r for r in read)


def test_counting_sessions_needs_no_sort(spark):
    for name in ("instance_load", "pool_rollup", "live_sessions", "quota_pressure", "last_activity", "concurrency", "touch_gaps"):
        plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan, name


def test_pool_and_day_filters_reach_the_files(spark):
    plan = contract.queries()["sessions_by_pool"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(pool,pool-3)" in plan and "PartitionFilters: [isnotnull(snapshot_date" in plan
