"""Plan regressions: the properties the scale design relies on."""

import os

import pytest

from farelens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _main_plan(plan):
    # the part of the plan outside scalar subqueries
    return plan.split("Subquery")[0]


def test_no_python_and_no_pairwise_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in QUERIES:
            plan = _plan(spark, name)
            for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
                        "Window ["):   # no window at all, so no single-partition window either
                assert bad not in plan, (name, bad)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_outlier_rows_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as if every input were large
    try:
        plan = _plan(spark, "outlier_report")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "TakeOrderedAndProject" in plan
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    for pruned in ("dep_time", "Arrival_time", "date_of_journey", "destination"):
        assert pruned not in plan           # column pruning reaches the scan


def test_report_text_is_made_for_the_kept_rows_only(spark):
    plan = _plan(spark, "outlier_report")
    assert "format_string" not in plan.split("TakeOrderedAndProject")[1]


def test_size_check_sums_in_the_tasks(spark):
    import inspect
    from farelens.plans import strategy
    assert ".limit(" not in inspect.getsource(strategy)      # a limit would gather rows in one task


def test_kpis_single_scan(spark):
    plan = _plan(spark, "kpi_bundle")
    assert plan.count("FileScan") == 1


def test_search_filters_reach_the_scan(spark):
    df = QUERIES["flight_search"](spark, SF)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(Source), IsNotNull(destination), EqualTo(Source,NATION_5), " \
           "EqualTo(destination,NATION_13)]" in plan


def test_text_operators_are_map_only(spark):
    for name in ("query_log_screen", "question_metric_match", "parse_duration", "parse_stops"):
        assert "Exchange" not in _plan(spark, name), name


def test_share_uses_a_scalar_subquery_not_a_window(spark):
    plan = _plan(spark, "freq_airline_share")
    assert "Subquery" in plan and "Window" not in plan
