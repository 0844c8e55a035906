"""Governed metrics, profiles and search on hand-built edge tables (FIXTURES §5)."""

import datetime as dt


from pyspark.sql import functions as F

from farelens import schema as S
from farelens.operators import metrics as M
from farelens.operators import profile as P
from farelens.operators import search as Q
from farelens.plans import dashboard as D

D1 = dt.date(2019, 3, 1)


def _row(airline="A", src="X", dst="Y", route=None, dur="2h", stops="non-stop", price=100, day=D1):
    return (airline, day, src, dst, route if route is not None else f"{src}-{dst}",
            "10:00:00", "12:00:00", dur, stops, price)


def _df(spark, rows):
    return spark.createDataFrame(rows, S.FLIGHTS)


def test_pair_collision_counts_once(spark):
    df = _df(spark, [_row(src="A", dst="BC"), _row(src="AB", dst="C")])
    assert M.scalar_metric(df, "total_routes") == 1          # glued text collides by definition
    assert P.od_routes(df).count() == 2                     # the separated label does not


def test_null_end_not_counted_as_route(spark):
    df = _df(spark, [_row(src=None, dst="Y"), _row()])
    assert M.scalar_metric(df, "total_routes") == 1
    home = D.home_counts(df).first()
    assert home["cities_covered"] == 2                      # NULL source kept as a value


def test_group_by_expression_not_stored_route(spark):
    # stored route text differs from Source+destination
    df = _df(spark, [_row(route="odd"), _row(route="odd2"), _row(src="Z", route="odd")])
    top = M.run_metric(df, "busiest_route").first()
    assert top["od_route"] == "X -> Y" and top["flights"] == 2


def test_nonstop_rate_exact_text_and_nulls_in_denominator(spark):
    df = _df(spark, [_row(stops="non-stop"), _row(stops="Non-Stop"), _row(stops=None), _row(stops="1 stop")])
    assert M.scalar_metric(df, "nonstop_rate") == 25.0


def test_nonstop_rate_half_up(spark):
    # 1 of 8 = 12.5 -> 12.5 ; 1 of 16 = 6.25 -> 6.3 (half up on the exact decimal)
    df = _df(spark, [_row(stops="non-stop")] + [_row(stops="1 stop")] * 15)
    assert M.scalar_metric(df, "nonstop_rate") == 6.3


def test_empty_table_metrics(spark):
    df = _df(spark, [])
    k = M.kpi_bundle(df).first()
    assert k["total_flights"] == 0 and k["avg_price"] is None
    assert M.scalar_metric(df, "nonstop_rate") is None
    assert M.run_metric(df, "busiest_route").isEmpty()


def test_rounded_vs_unrounded_order(spark):
    # B: mean 100.4 (rounds to 100), A: mean 100.0; C: 100.5 (rounds to 101)
    rows = [_row(airline="A", price=100)] + [_row(airline="B", price=p) for p in (100, 100, 100, 100, 102)] \
        + [_row(airline="C", price=p) for p in (100, 101)]
    by_rounded = [r["airline"] for r in M.run_metric(_df(spark, rows), "avg_price_by_airline").collect()]
    by_raw = [r["airline"] for r in P.avg_price_airline_chart(_df(spark, rows)).collect()]
    assert by_rounded == ["C", "A", "B"]                   # A and B tie at 100: airline order
    assert by_raw == ["C", "B", "A"]


def test_share_of_total(spark):
    rows = [_row(airline="A")] * 3 + [_row(airline="B")]
    got = {r["airline"]: r["share"] for r in P.freq_airline_share(_df(spark, rows)).collect()}
    assert got == {"A": 0.75, "B": 0.25}


def test_month_and_year_buckets(spark):
    rows = [_row(day=dt.date(2019, 3, 1)), _row(day=dt.date(2019, 3, 30)), _row(day=dt.date(2020, 1, 2))]
    assert [tuple(r) for r in P.freq_month(_df(spark, rows)).collect()] == [("2019-03", 2), ("2020-01", 1)]
    assert [tuple(r) for r in P.freq_year(_df(spark, rows)).collect()] == [(2019, 2), (2020, 1)]


def test_search_sort_filter_and_cheapest(spark):
    rows = [_row(airline="A", price=300, dur="10h"), _row(airline="B", price=100, dur="2h"),
            _row(airline="C", price=100, dur="3h"), _row(airline="A", price=50, dur="1h", dst="Q")]
    df = _df(spark, rows)
    res = Q.search_flights(df, "X", "Y").collect()
    assert [r["Price"] for r in res] == [100, 100, 300]
    assert [r["is_cheapest"] for r in res] == [True, True, False]
    assert res[0]["highlight"] == "#d4edda"
    # cheapest is taken over the airline-filtered rows
    res = Q.search_flights(df, "X", "Y", airlines=["A"]).collect()
    assert [(r["Price"], r["is_cheapest"]) for r in res] == [(300, True)]
    # duration sorted as text: "10h" < "2h" < "3h"
    by_text = [r["Duration"] for r in Q.sort_rows(Q.route_rows(df, "X", "Y"), "duration", "text").collect()]
    assert by_text == ["10h", "2h", "3h"]
    by_min = [r["Duration"] for r in Q.sort_rows(Q.route_rows(df, "X", "Y"), "duration").collect()]
    assert by_min == ["2h", "3h", "10h"]
    summ = Q.search_summary(df, "X", "Y").first()
    assert (summ["flights_found"], summ["cheapest_price"]) == (3, 100)
    assert summ["banner"] == "3 flights found | Cheapest: ₹100"
    assert Q.search_summary(df, "Y", "X").first()["banner"] == "No flights found for this route!"


def test_search_literal_is_not_sql(spark):
    df = _df(spark, [_row()])
    assert Q.route_rows(df, "X' OR '1'='1", "Y").count() == 0


def test_search_filter_pushed_to_parquet(spark, tmp_path):
    path = str(tmp_path / "f")
    _df(spark, [_row(), _row(src="Z")]).write.parquet(path)
    plan = Q.route_rows(spark.read.parquet(path), "X", "Y")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(Source,X)" in plan


def test_dashboard_feeds(spark):
    feeds = D.dashboard(_df(spark, [_row(), _row(airline="B", src="Z")]))
    assert set(feeds) == {"kpis", "flights_per_airline", "avg_price_per_airline", "busiest_airports",
                          "top_routes", "flights_per_month", "flights_per_year"}
    assert feeds["top_routes"].first()["od_route"] in ("X → Y", "Z → Y")


def test_kpi_labels(spark):
    got = {r["label"]: r["value"] for r in D.kpi_labels(_df(spark, [_row(price=100), _row(price=201)])).collect()}
    assert got == {"Total Flights": "2", "Total Airlines": "1", "Total Routes": "1", "Avg Price": "₹151.0"}


def test_distinct_cities_keeps_null(spark):
    got = Q.distinct_cities(_df(spark, [_row(src=None), _row()])).collect()
    assert ("source", None) in [tuple(r) for r in got]


def test_metric_match_ignores_other_filters(spark):
    # a governed match answers the global question even when the text narrows it
    from farelens.operators.questions import answer
    df = _df(spark, [_row(src="Delhi"), _row(src="Mumbai"), _row(src="Mumbai")])
    a = answer(df, "how many flights from Delhi?")
    assert a.metric_key == "total_flights" and a.data.first()[0] == 3
    assert a.chart == "none" and a.sample.first()["record"] == '{"total_flights":3}'


def test_summary_over_route_cheapest_over_filtered(spark):
    rows = [_row(airline="A", price=300), _row(airline="B", price=100)]
    df = _df(spark, rows)
    assert Q.search_summary(df, "X", "Y").first()["cheapest_price"] == 100
    marked = Q.search_flights(df, "X", "Y", airlines=["A"]).collect()
    assert [(r["Price"], r["is_cheapest"]) for r in marked] == [(300, True)]


def test_no_match_answer(spark):
    from farelens.operators.questions import answer
    a = answer(_df(spark, [_row()]), "Show me flights from Mumbai to Delhi under 5000")
    assert a.metric_key is None and a.data is None


def test_top1_ties_prefer_named_group_over_null(spark):
    df = _df(spark, [_row(src=None), _row(src="B"), _row(src="A", dst="Z")])
    top = M.run_metric(df, "busiest_airport").first()
    assert tuple(top) == ("A", 1)          # three-way tie: key order, NULL last
    assert tuple(M.run_metric(df, "busiest_route").first()) == ("A -> Z", 1)


def test_home_counts_empty_table(spark):
    got = D.home_counts(_df(spark, [])).first()
    assert tuple(got) == (0, 0, 0, 0)


def test_search_ignore_case(spark):
    df = _df(spark, [_row(src="Delhi", dst="Mumbai", price=100), _row(src="DELHI", dst="mumbai", price=90)])
    assert Q.route_rows(df, "delhi", "MUMBAI").count() == 0
    assert Q.route_rows(df, "delhi", "MUMBAI", ignore_case=True).count() == 2
    assert Q.search_summary(df, "Delhi", "Mumbai", ignore_case=True).first()["cheapest_price"] == 90
    marked = Q.search_flights(df, "delhi", "mumbai", ignore_case=True).collect()
    assert [(r["Price"], r["is_cheapest"]) for r in marked] == [(90, True), (100, False)]


def test_one_pass_dashboard_with_null_keys(spark):
    rows = [_row(airline=None, src=None), _row(airline="A"), _row(airline="A", src="Z", price=300),
            _row(airline="B", dst=None, price=None)]
    df = _df(spark, rows)
    one, many = D.dashboard(df, one_pass=True), D.dashboard(df, one_pass=False)
    for name in one:
        a = sorted((tuple(r) for r in one[name].collect()), key=str)
        b = sorted((tuple(r) for r in many[name].collect()), key=str)
        assert a == b, name


def test_bulk_answers(spark):
    import json as _json
    from farelens.operators.questions import answer_questions
    df = _df(spark, [_row(price=100), _row(price=201), _row(airline="B", src="Z", price=50)])
    qs = spark.createDataFrame([("what is the average price?",), ("busiest route please",), ("hello",)],
                               "question string")
    got = {r["question"]: (r["metric_first"], r["row_count"], r["sample"]) for r in answer_questions(qs, df).collect()}
    assert got["hello"] == (None, None, None)
    assert got["what is the average price?"] == ("avg_price", 1, '[{"avg_price":117.0}]')
    key, n, sample = got["busiest route please"]
    assert key == "busiest_route" and n == 1 and _json.loads(sample) == [{"od_route": "X -> Y", "flights": 2}]


def test_governed_results_are_whole(spark):
    import json as _json
    from farelens.operators.questions import answer_questions, governed_rows
    df = _df(spark, [_row(airline=f"A{i:02d}", price=100 + i) for i in range(50)])
    rows = governed_rows(df).where("metric_key = 'avg_price_by_airline'").orderBy(F.desc("sort_value")).collect()
    assert [_json.loads(r["record"]) for r in rows] == \
        [{"airline": f"A{i:02d}", "avg_price": 100.0 + i} for i in reversed(range(50))]
    qs = spark.createDataFrame([("price by airline",)], "question string")
    got = answer_questions(qs, df, mode="longest").first()
    assert got["row_count"] == 50 and len(_json.loads(got["sample"])) == 20


def test_results_without_a_checkpoint_folder(spark):
    # a session that never set one: metric_results sets it itself
    assert M.metric_results(_df(spark, [_row()]))["total_flights"].first()[0] == 1


def test_parameterised_sql_search(spark):
    from farelens.sources import register_view
    df = register_view(_df(spark, [_row(), _row(src="Z"), _row(price=50)]), "flights_param_test")
    a = sorted(tuple(r) for r in Q.route_rows_sql(spark, "X", "Y", "flights_param_test").collect())
    b = sorted(tuple(r) for r in Q.route_rows(df, "X", "Y").collect())
    assert a == b and len(a) == 2
    assert Q.route_rows_sql(spark, "X' OR '1'='1", "Y", "flights_param_test").count() == 0


def test_one_pass_metric_results_equal_governed(spark):
    rows = [_row(airline=None, src=None), _row(stops="Non-Stop"), _row(airline="B", src="Z", price=300),
            _row(airline="B", dst=None, price=None, stops=None), _row(src="A", dst="BC"), _row(src="AB", dst="C")]
    for data in (rows, []):
        df = _df(spark, data)
        one = M.metric_results(df)
        for key in M.REGISTRY:
            a, b = one[key], M.run_metric(df, key)
            assert a.columns == b.columns, key
            assert a.schema == b.schema, key
            assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()], key


def test_airline_filter_keeps_null_when_listed(spark):
    df = _df(spark, [_row(airline=None), _row(airline="A"), _row(airline="B")])
    rows = Q.route_rows(df, "X", "Y")
    assert sorted(r["Airline"] or "" for r in Q.filter_airlines(rows, ["A", None]).collect()) == ["", "A"]
    assert [r["Airline"] for r in Q.filter_airlines(rows, ["B"]).collect()] == ["B"]
    assert Q.filter_airlines(rows, []).count() == 0
    assert Q.filter_airlines(rows, None).count() == 3
