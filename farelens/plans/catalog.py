"""The query catalog: every operator as a named query over a test-data folder.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame. All of them start
from the fare table derived from the star schema in ``sf_dir`` (written once,
then scanned), so their work grows with the input. Most plans are lazy; the
outlier queries, ``question_answers``, ``governed_rows`` and
``result_chart_kind`` checkpoint a small aggregate while they are built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens import schema as S
from farelens.functions.parsing import stops_num, with_parsed
from farelens.operators import metrics as M
from farelens.operators import metrics_sql as MS
from farelens.operators import moments as MO
from farelens.operators import outliers as O
from farelens.operators import profile as P
from farelens.operators import search as Q
from farelens.operators.questions import answer_questions, governed_rows, match_questions
from farelens.operators.results import chart_kind_column, sample_json
from farelens.operators.screen import screen_log
from farelens.plans import dashboard as D
from farelens.plans.inputs import question_log, sql_log
from farelens.sources import flights_table, register_view

# The search-page parameters used by the registered searches.
SEARCH_SOURCE = "NATION_5"
SEARCH_DESTINATION = "NATION_13"
SEARCH_AIRLINES = ["Brand#1", "Brand#12", "Brand#23"]

Query = Callable[[SparkSession, str], DataFrame]


def _date_text(df: DataFrame) -> DataFrame:
    """Search results with the travel date as ISO text (yyyy-MM-dd), the form
    the result grid shows; keeps the result free of engine-specific date
    conversions when it leaves Spark."""
    return df.withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))


def _on_flights(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(flights_table(spark, sf_dir))


def _metric(key: str) -> Query:
    return _on_flights(lambda fl: M.run_metric(fl, key))


def _r4(c: str):
    return F.round(F.col(c), 4).alias(c)


def _route_stats(fl: DataFrame) -> DataFrame:
    st = O.group_stats(O.clean(O.outlier_input(fl)))
    return st.select("Route", *[_r4(c) for c in st.columns if c.endswith(("_mean", "_std"))], "route_size")


def _merged_stats(fl: DataFrame) -> DataFrame:
    """Moments per route and year of travel, merged over the years."""
    rows = MO.clean(fl.select(F.col(S.ROUTE).alias("Route"), S.PRICE, "duration_minutes", "stops_num",
                              F.year(S.DATE).alias("year")))
    st = MO.stats_of(MO.merge_moments(MO.group_moments(rows, batch="year"), batch="year"))
    return st.select("Route", *[_r4(c) for c in st.columns if c.endswith(("_mean", "_std"))], "route_size")


def _listed_airlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows of the airlines named by a table: the brands of large parts."""
    listed = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 45").select("p_brand")
    rows = Q.route_rows(flights_table(spark, sf_dir), SEARCH_SOURCE, SEARCH_DESTINATION)
    return _date_text(Q.filter_airlines_table(rows, listed, "p_brand"))


def _zscores(fl: DataFrame) -> DataFrame:
    z = O.group_zscores(O.clean(O.outlier_input(fl)))
    return z.select("Airline", "Route", "Price", "duration_minutes", "stops_num", "route_size",
                    _r4("price_z"), _r4("duration_z"), _r4("stops_z"))


def _flags(fl: DataFrame) -> DataFrame:
    return O.detect(fl).select(
        "Airline", "Route", "Price", "duration_minutes", "stops_num",
        "price_flag", "duration_flag", "stops_flag", "severity_score", "Severity", _r4("max_abs_z"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_questions(question_log(flights_table(spark, sf_dir), spark, sf_dir), "question")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fl = flights_table(spark, sf_dir)
    return answer_questions(question_log(fl, spark, sf_dir), fl, "question", "first")


def _search_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route search as SQL text over a view of the fare table."""
    register_view(flights_table(spark, sf_dir), "flights_catalog")
    return _date_text(Q.route_rows_sql(spark, SEARCH_SOURCE, SEARCH_DESTINATION, "flights_catalog"))


def _governed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine governed results through their SQL table functions."""
    fl = register_view(flights_table(spark, sf_dir), "flights_catalog")
    MS.register_metrics(spark, "flights_catalog")
    return governed_rows(fl, {key: MS.run_metric_sql(spark, key, "flights_catalog") for key in MS.METRIC_SQL})


def _slice_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean price by airline of one route, asked for in SQL with parameters."""
    register_view(flights_table(spark, sf_dir), "flights_catalog")
    MS.register_metrics(spark, "flights_catalog")
    return MS.run_metric_sql(spark, "avg_price_by_airline", "flights_catalog",
                             from_city=SEARCH_SOURCE, to_city=SEARCH_DESTINATION)


def _screen(fl: DataFrame) -> DataFrame:
    return screen_log(sql_log(fl), "sql_text")


def _chart_kinds(fl: DataFrame) -> DataFrame:
    results = M.metric_results(fl)           # all nine results from one scan
    parts = [chart_kind_column(results[k]).select(F.lit(k).alias("metric_key"), "chart_kind")
             for k in M.REGISTRY]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES: dict[str, Query] = {
    # governed metrics
    "metric_total_flights": _metric("total_flights"),
    "metric_total_airlines": _metric("total_airlines"),
    "metric_total_routes": _metric("total_routes"),
    "metric_avg_price": _metric("avg_price"),
    "metric_nonstop_rate": _metric("nonstop_rate"),
    "metric_busiest_route": _metric("busiest_route"),
    "metric_busiest_airport": _metric("busiest_airport"),
    "metric_avg_price_by_airline": _metric("avg_price_by_airline"),
    "metric_cheapest_by_route": _metric("cheapest_flight_by_route"),
    # KPI cards and home page
    "kpi_bundle": _on_flights(M.kpi_bundle),
    "kpi_labels": _on_flights(D.kpi_labels),
    "home_counts": _on_flights(D.home_counts),
    # profiles
    "freq_airline": _on_flights(P.freq_airline),
    "freq_airline_share": _on_flights(P.freq_airline_share),
    "freq_airport": _on_flights(P.freq_airport),
    "freq_month": _on_flights(P.freq_month),
    "freq_year": _on_flights(P.freq_year),
    "top_routes": _on_flights(P.top_routes),
    "avg_price_airline_chart": _on_flights(P.avg_price_airline_chart),
    "od_route": _on_flights(P.od_routes),
    # the whole analytics page from one scan (grouping sets)
    "dashboard_feeds": _on_flights(D.dashboard_feeds),
    # route search
    "flight_search": _on_flights(lambda fl: _date_text(Q.sort_rows(
        Q.route_rows(fl, SEARCH_SOURCE, SEARCH_DESTINATION), "price"))),
    "flight_search_by_duration": _on_flights(lambda fl: _date_text(Q.sort_rows(
        Q.route_rows(fl, SEARCH_SOURCE, SEARCH_DESTINATION), "duration"))),
    "flight_search_by_duration_text": _on_flights(lambda fl: _date_text(Q.sort_rows(
        Q.route_rows(fl, SEARCH_SOURCE, SEARCH_DESTINATION), "duration", "text"))),
    "flight_search_sql": _search_sql,
    "flight_search_airlines": _on_flights(lambda fl: _date_text(Q.filter_airlines(
        Q.route_rows(fl, SEARCH_SOURCE, SEARCH_DESTINATION), SEARCH_AIRLINES))),
    "flight_search_airline_table": _listed_airlines,
    "flight_search_cheapest": _on_flights(lambda fl: _date_text(Q.search_flights(
        fl, SEARCH_SOURCE, SEARCH_DESTINATION, "price", SEARCH_AIRLINES))),
    "search_summary": _on_flights(lambda fl: Q.search_summary(fl, SEARCH_SOURCE, SEARCH_DESTINATION)),
    "search_summary_empty": _on_flights(lambda fl: Q.search_summary(fl, SEARCH_SOURCE, SEARCH_SOURCE + "_")),
    "search_airlines": _on_flights(lambda fl: Q.search_airlines(fl, SEARCH_SOURCE, SEARCH_DESTINATION)),
    "distinct_cities": _on_flights(Q.distinct_cities),
    # text parsing
    # the parse itself, run on the raw text columns (the stored table also
    # keeps the parsed columns from ingest; these re-derive them)
    "parse_duration": _on_flights(lambda fl: with_parsed(fl.select("Duration", "Total_stops")).select(
        "Duration", "duration_minutes")),
    "parse_stops": _on_flights(lambda fl: fl.select(
        "Total_stops", stops_num("Total_stops").alias("stops_num"))),
    # outliers
    "outlier_clean": _on_flights(lambda fl: O.clean(O.outlier_input(fl))),
    "outlier_route_stats": _on_flights(_route_stats),
    "outlier_merged_stats": _on_flights(_merged_stats),
    "outlier_zscores": _on_flights(_zscores),
    "outlier_flags": _on_flights(_flags),
    "outlier_report": _on_flights(lambda fl: O.report(O.detect(fl))),
    "outlier_severity_counts": _on_flights(lambda fl: O.severity_counts(O.detect(fl))),
    "outlier_narrative": _on_flights(lambda fl: O.with_narrative(O.detect(fl)).select(
        "Airline", "Route", "Price", "Severity", "explanation")),
    # questions, screening, result helpers
    "question_metric_match": _questions,
    "question_answers": _answers,
    "governed_rows": _on_flights(governed_rows),
    "governed_rows_sql": _governed_sql,
    "metric_slice_sql": _slice_sql,
    "query_log_screen": _on_flights(_screen),
    "result_sample_json": _on_flights(lambda fl: sample_json(M.run_metric(fl, "avg_price_by_airline"))),
    "result_chart_kind": _on_flights(_chart_kinds),
}
