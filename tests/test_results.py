"""Result helpers and the size-checked broadcast."""

import json

from farelens.operators.results import chart_kind, sample_json
from farelens.plans.strategy import bounded_broadcast


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chart_kind_rules(spark):
    assert chart_kind(spark.createDataFrame([(1,)], "a int")) == "none"            # one column
    assert chart_kind(spark.createDataFrame([], "a string, b int")) == "none"      # no rows
    assert chart_kind(spark.createDataFrame([("x", "y")], "a string, b string")) == "none"
    assert chart_kind(spark.createDataFrame([(str(i), i) for i in range(15)], "a string, b int")) == "bar"
    assert chart_kind(spark.createDataFrame([(str(i), i) for i in range(16)], "a string, b int")) == "line"
    assert chart_kind(spark.createDataFrame([("x", True)], "a string, b boolean")) == "bar"
    assert chart_kind(spark.createDataFrame([("x", 1.5)], "a string, b double")) == "bar"


def test_sample_json_keeps_order_and_bounds(spark):
    df = spark.createDataFrame([(f"k{i:02d}", i) for i in range(30)], "k string, v int").orderBy("v")
    got = sample_json(df).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 21))
    assert [json.loads(r["record"]) for r in got[:2]] == [{"k": "k00", "v": 0}, {"k": "k01", "v": 1}]
    assert sample_json(df, 5).count() == 5


def test_bounded_broadcast_checks_size(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    long_keys = spark.range(10).selectExpr("id as k", "repeat('x', 1000) as name")   # few rows, many bytes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(bounded_broadcast(small, max_bytes=4000), "k")
        assert "BroadcastHashJoin" in _plan(hinted)
        for other in (big.select("k"), long_keys):
            assert "BroadcastHashJoin" not in _plan(big.join(bounded_broadcast(other, max_bytes=4000), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
