"""Joins and ordered operators under hot keys, against the plain forms."""

import random

import pytest
from pyspark.sql import Window, functions as F

from poolwatch.operators.scan import nearest, position_bucket, running_sum, time_bucket


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one key, some keys without a match."""
    rng = random.Random(7)
    other = lambda: None if rng.random() < 0.1 else f"k{rng.randrange(40)}"
    data = [("hot" if i % 3 == 0 else other(), i, rng.randrange(5)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, i int, v int")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_adaptive_execution_splits_a_hot_key(spark, how):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        many = spark.range(0, 40000, 1, 8).selectExpr("if(id % 3 = 0, -1, id % 500) as k", "id", "uuid() as filler")
        keys = spark.range(-1, 400).selectExpr("id as k", "id * 2 as n")
        joined = many.join(keys, ["k"], how).groupBy("k").agg(F.count("*").alias("n"))
        got = dict(joined.collect())
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = 13334
    assert got.get(-1) == (None if how == "left_anti" else hot)
    assert "skew=true" in plan


@pytest.mark.parametrize("width", [1, 7, 500, 100000])
def test_running_sum_equals_one_window(hot, width):
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumn("s", F.sum("v").over(w))
    got = running_sum(hot, ["k"], ["i"], "v", "s", position_bucket("i", width))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("fine, coarse", [(1, 1), (7, 100), (50, 3000)])
def test_running_sum_in_two_levels(hot, fine, coarse):
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumn("s", F.sum("v").over(w))
    got = running_sum(hot, ["k"], ["i"], "v", "s", position_bucket("i", fine), position_bucket("_fine", coarse))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("unit", ["minute", "hour", "day"])
def test_nearest_equals_windows(hot, unit):
    rows = hot.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, i, 0)"))
    rows = rows.withColumn("mark", F.expr("if(v = 0, ts, null)"))
    w = Window.partitionBy("k").orderBy("ts", "i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.withColumns(
        {
            "newest": F.last("mark", True).over(upto),
            "previous": F.last("ts").over(before),
            "coming": F.first("mark", True).over(onward),
        }
    )
    got = nearest(
        rows, ["k"], ["ts", "i"], time_bucket("ts", unit),
        newest={"newest": "mark"}, previous={"previous": "ts"}, coming={"coming": "mark"},
    ).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
