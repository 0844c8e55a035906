"""Frequency and trend profiles (the dashboard's chart feeds).

Each is one grouped aggregate: partial aggregation runs before the shuffle,
so only one row per group and per task crosses the network however skewed
the keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens import schema as S
from farelens.functions.text import ARROW_ASCII, ARROW_UNICODE, od_route


def frequency(df: DataFrame, key: Column | str, name: str | None = None,
              count_name: str = "flights") -> DataFrame:
    """Rows per value of ``key`` (NULL is its own group)."""
    key = F.col(key) if isinstance(key, str) else key
    if name is not None:
        key = key.alias(name)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))


def share_of_total(grouped: DataFrame, count_col: str = "flights",
                   name: str = "share") -> DataFrame:
    """Add each group's fraction of the total.

    The total is a scalar subquery over the grouped result: Spark runs it as
    its own small job and inlines the value, so no single-partition window
    and no join is needed.
    """
    total = grouped.select(F.sum(count_col)).scalar()
    return grouped.withColumn(name, F.col(count_col) / total)


def freq_airline(df: DataFrame) -> DataFrame:
    return frequency(df, S.AIRLINE)


def freq_airline_share(df: DataFrame) -> DataFrame:
    return share_of_total(freq_airline(df))


def freq_airport(df: DataFrame) -> DataFrame:
    return (frequency(df, S.SOURCE, "airport")
            .orderBy(F.desc("flights"), F.asc_nulls_last("airport")))


def time_bucket(df: DataFrame, unit: str = "month") -> DataFrame:
    """Rows per calendar month (``yyyy-MM`` text) or per year (int)."""
    if unit == "month":
        key = F.date_format(F.col(S.DATE), "yyyy-MM").alias("month")
    elif unit == "year":
        key = F.year(F.col(S.DATE)).cast("int").alias("year")
    else:
        raise ValueError(unit)
    return frequency(df, key).orderBy(unit)


def freq_month(df: DataFrame) -> DataFrame:
    return time_bucket(df, "month")


def freq_year(df: DataFrame) -> DataFrame:
    return time_bucket(df, "year")


def top_k(grouped: DataFrame, k: int, by: str, key: str) -> DataFrame:
    """The k largest groups; ties broken by the key so the cut is stable.
    Planned as TakeOrderedAndProject (a per-task top-k then a k-row merge)."""
    return grouped.orderBy(F.desc(by), F.asc_nulls_last(key)).limit(k)


def top_routes(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(frequency(df, od_route(ARROW_UNICODE), S.OD_ROUTE), k, "flights", S.OD_ROUTE)


def avg_price_airline_chart(df: DataFrame) -> DataFrame:
    """Average price per airline (rounded), ordered by the unrounded mean."""
    return (df.groupBy(S.AIRLINE)
            .agg(F.avg(S.PRICE).alias("_mean"))
            .orderBy(F.desc("_mean"), F.asc_nulls_last(S.AIRLINE))
            .select(S.AIRLINE, F.round("_mean", 0).alias("avg_price")))


def od_routes(df: DataFrame, sep: str = ARROW_ASCII) -> DataFrame:
    """Distinct origin-destination pairs with their label."""
    return (df.select(S.SOURCE, S.DESTINATION).distinct()
            .withColumn(S.OD_ROUTE, od_route(sep)))
