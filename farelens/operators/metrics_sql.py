"""The governed metrics as SQL text.

Every metric is a SQL table function over a registered fare-table view, so that
SQL callers ask for it by name: ``SELECT * FROM flights_avg_price()``. All take
the same named parameters, each of which narrows the rows if it is given:
``from_city``, ``to_city``, ``carrier``, ``first_day`` and ``last_day``. Values are
bound as named parameters of the statement, never pasted into its text, and a
parameter that is not given folds away; one that is given reaches the scan as a
filter.

Results equal :func:`farelens.operators.metrics.run_metric` over the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from farelens import schema as S
from farelens.functions.text import ARROW_ASCII

PARAMETERS = {"from_city": "STRING", "to_city": "STRING", "carrier": "STRING", "first_day": "DATE", "last_day": "DATE"}
_ROWS = (f"(from_city IS NULL OR {S.SOURCE} = from_city) AND (to_city IS NULL OR {S.DESTINATION} = to_city)"
         f" AND (carrier IS NULL OR {S.AIRLINE} = carrier)"
         f" AND (first_day IS NULL OR {S.DATE} >= first_day) AND (last_day IS NULL OR {S.DATE} <= last_day)")
_ROUTE = f"concat({S.SOURCE}, '{ARROW_ASCII}', {S.DESTINATION})"


@dataclass(frozen=True)
class SqlMetric:
    columns: str             # of the result, as DDL
    select: str              # the definition; {rows} stands for FROM and WHERE
    order: str = ""          # of the result's rows


METRIC_SQL: dict[str, SqlMetric] = {
    "total_flights": SqlMetric("total_flights BIGINT", "SELECT count(*) {rows}"),
    "total_airlines": SqlMetric("total_airlines BIGINT", f"SELECT count(DISTINCT {S.AIRLINE}) {{rows}}"),
    "total_routes": SqlMetric("total_routes BIGINT", f"SELECT count(DISTINCT concat({S.SOURCE}, {S.DESTINATION})) {{rows}}"),
    "avg_price": SqlMetric("avg_price DOUBLE", f"SELECT round(avg({S.PRICE}), 0) {{rows}}"),
    "nonstop_rate": SqlMetric("nonstop_rate DOUBLE", (
        f"SELECT CAST(round(100.0 * sum(CASE WHEN {S.STOPS} = 'non-stop' THEN 1 ELSE 0 END) / nullif(count(*), 0), 1)"
        " AS DOUBLE) {rows}")),
    "busiest_route": SqlMetric(f"{S.OD_ROUTE} STRING, flights BIGINT", (
        f"SELECT {_ROUTE} AS label, count(*) AS n {{rows}} GROUP BY label ORDER BY n DESC, label ASC NULLS LAST LIMIT 1")),
    "busiest_airport": SqlMetric("airport STRING, flights BIGINT", (
        f"SELECT {S.SOURCE}, count(*) AS n {{rows}} GROUP BY {S.SOURCE} ORDER BY n DESC, {S.SOURCE} ASC NULLS LAST LIMIT 1")),
    "avg_price_by_airline": SqlMetric(f"{S.AIRLINE} STRING, avg_price DOUBLE", (
        f"SELECT {S.AIRLINE}, round(avg({S.PRICE}), 0) {{rows}} GROUP BY {S.AIRLINE}"),
        f"avg_price DESC, {S.AIRLINE} ASC NULLS LAST"),
    "cheapest_flight_by_route": SqlMetric(f"{S.OD_ROUTE} STRING, cheapest_price INT", (
        f"SELECT {_ROUTE} AS label, min({S.PRICE}) {{rows}} GROUP BY label"),
        f"cheapest_price ASC NULLS LAST, {S.OD_ROUTE} ASC NULLS LAST"),
}


def function_name(key: str, view: str = "flights") -> str:
    if key not in METRIC_SQL:
        raise KeyError(key)
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", view):
        raise ValueError(f"not a view's name: {view!r}")
    return f"{view}_{key}"


def register_metrics(spark: SparkSession, view: str = "flights") -> list[str]:
    """Create the session's nine table functions over ``view``; their names."""
    takes = ", ".join(f"{p} {t} DEFAULT NULL" for p, t in PARAMETERS.items())
    names = []
    for key, metric in METRIC_SQL.items():
        names.append(function_name(key, view))
        rows = f"FROM {view} WHERE {_ROWS}"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[-1]}({takes}) RETURNS TABLE ({metric.columns}) "
                  f"RETURN {metric.select.format(rows=rows)}")
    return names


def run_metric_sql(spark: SparkSession, key: str, view: str = "flights", **given) -> DataFrame:
    """The governed result for ``key`` through its table function, in its order.
    ``given``: values of :data:`PARAMETERS`; the functions have to be registered."""
    unknown = set(given) - set(PARAMETERS)
    if unknown:
        raise TypeError(f"no such parameters: {sorted(unknown)}")
    call = ", ".join(f"{p} => :{p}" for p in given)
    order = f" ORDER BY {METRIC_SQL[key].order}" if METRIC_SQL[key].order else ""
    return spark.sql(f"SELECT * FROM {function_name(key, view)}({call}){order}", args=given)
