"""Catalog queries: expected values computed independently (FIXTURES §4), the
DuckDB oracle at sf0.001, and the driver entry points."""

import os

import pytest

from farelens.operators import metrics as M
from farelens.operators import outliers as O
from farelens.sources import flights_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def test_fixture_values_sf0001(spark):
    fl = flights_table(spark, SF)
    k = M.kpi_bundle(fl).first()
    assert (k["total_flights"], k["total_airlines"], k["total_routes"], k["avg_price"]) == (6000, 25, 250, 5450.0)
    assert M.scalar_metric(fl, "nonstop_rate") == 70.2
    assert tuple(M.run_metric(fl, "busiest_route").first()) == ("NATION_20 -> NATION_11", 62)
    assert tuple(M.run_metric(fl, "busiest_airport").first()) == ("NATION_19", 640)
    counts = O.severity_counts(O.detect(fl)).first()
    assert (counts["low"], counts["medium"], counts["high"], counts["flagged_total"]) == (433, 30, 0, 463)
    assert O.clean(O.outlier_input(fl)).count() == 5962


def test_all_queries_match_oracle_sf0001(spark):
    from oracle_compare import compare, duck
    from __spark_entry__ import oracle_sql, queries
    from farelens.plans.catalog import QUERIES
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())
    con = duck(SF)
    failures = []
    for name in QUERIES:
        ok, msg = compare(spark, con, name, SF)
        if not ok:
            failures.append((name, msg))
    assert not failures


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 8
    assert df.columns[:3] == ["Airline", "Route", "Price"]


def test_kpi_values_and_one_call_report(spark):
    fl = flights_table(spark, SF)
    assert M.kpi_values(fl) == (6000, 25, 250, 5450.0)
    assert O.outlier_report(fl).count() == 8


@pytest.mark.parametrize("sf,expected", [
    ("/root/testdata/sf0.01", dict(total=60000, routes=625, avg=5465.0, nonstop=70.9,
                                   route=("NATION_9 -> NATION_10", 291), airport=("NATION_9", 5950),
                                   clean=59667, sev=(3515, 305, 17, 3837))),
    ("/root/testdata/sf0.1", dict(total=600000, routes=625, avg=5459.0, nonstop=71.1,
                                  route=("NATION_5 -> NATION_13", 1343), airport=("NATION_23", 31138),
                                  clean=596537, sev=(34339, 3300, 142, 37781))),
])
def test_fixture_values_larger_scales(spark, sf, expected):
    if not os.path.exists(sf):
        pytest.skip("test data not present")
    fl = flights_table(spark, sf)
    k = M.kpi_bundle(fl).first()
    assert (k["total_flights"], k["total_airlines"], k["total_routes"], k["avg_price"]) == \
        (expected["total"], 25, expected["routes"], expected["avg"])
    assert M.scalar_metric(fl, "nonstop_rate") == expected["nonstop"]
    assert tuple(M.run_metric(fl, "busiest_route").first()) == expected["route"]
    assert tuple(M.run_metric(fl, "busiest_airport").first()) == expected["airport"]
    assert O.clean(O.outlier_input(fl)).count() == expected["clean"]
    c = O.severity_counts(O.detect(fl)).first()
    assert (c["low"], c["medium"], c["high"], c["flagged_total"]) == expected["sev"]


def test_outlier_shuffle_join_fallback_matches_broadcast_path(spark):
    """Above the stats bound the join is a sort-merge join; same answer."""
    fl = flights_table(spark, SF)
    want = sorted(tuple(r) for r in O.detect(fl).select("Airline", "Route", "Price", "severity_score").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        forced = O.detect(fl, broadcast_max_bytes=1)          # 250 routes take more: no broadcast
        plan = forced._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        got = sorted(tuple(r) for r in forced.select("Airline", "Route", "Price", "severity_score").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(got) == 463


def test_one_pass_dashboard_equals_independent_plans(spark):
    from farelens.plans.dashboard import dashboard
    fl = flights_table(spark, SF)
    one, many = dashboard(fl, one_pass=True), dashboard(fl, one_pass=False)
    assert set(one) == set(many)
    for name in one:
        a = [tuple(r) for r in one[name].collect()]
        b = [tuple(r) for r in many[name].collect()]
        assert one[name].columns == many[name].columns, name
        if name == "flights_per_airline":      # the only unordered feed
            a, b = sorted(a), sorted(b)
        assert a == b, name
    # one scan of the fact table feeds the whole page
    plan = fl.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(
        __import__("farelens.plans.dashboard", fromlist=["x"]).dashboard_feeds(fl)._jdf.queryExecution(), "simple")
    assert plan.count("FileScan") == 1 and "Expand" in plan


def test_queries_hold_under_other_session_settings(spark):
    """Same answers with AQE off, ANSI off, no automatic broadcasts and a
    non-UTC session time zone."""
    from oracle_compare import compare, duck
    from farelens.plans.catalog import QUERIES
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.ansi.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.session.timeZone": "America/Los_Angeles"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        con = duck(SF)
        bad = [(n, m) for n in QUERIES for ok, m in [compare(spark, con, n, SF)] if not ok]
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert not bad


def test_one_pass_metric_results_on_data(spark):
    fl = flights_table(spark, SF)
    one = M.metric_results(fl)
    for key in M.REGISTRY:
        assert one[key].schema == M.run_metric(fl, key).schema, key
        assert [tuple(r) for r in one[key].collect()] == [tuple(r) for r in M.run_metric(fl, key).collect()], key
