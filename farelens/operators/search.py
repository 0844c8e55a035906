"""Route search: filtered rows, summary, airline filter and cheapest marking.

The route predicate is built from column literals (never pasted into SQL
text), so it is injection-free and Catalyst pushes it into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens import schema as S
from farelens.functions.parsing import duration_minutes
from farelens.functions.text import RUPEE
from farelens.plans.strategy import bounded_broadcast
from farelens.sources.layout import bucket_column, rows_of_bucket

# Result column names of the search page and the highlight colour.
SEARCH_COLUMNS = [
    (S.AIRLINE, "Airline"), (S.DATE, "Date"), (S.ROUTE, "Route"),
    (S.DEP_TIME, "Departure"), (S.ARRIVAL_TIME, "Arrival"),
    (S.DURATION, "Duration"), (S.STOPS, "Stops"), (S.PRICE, "Price"),
]
CHEAPEST_COLOUR = "#d4edda"
# The summary banner's texts.
FOUND_BANNER = f"%d flights found | Cheapest: {RUPEE}%d"
EMPTY_BANNER = "No flights found for this route!"

_OUT = [out for _, out in SEARCH_COLUMNS]


def _route_filter(source: str, destination: str, ignore_case: bool = False) -> Column:
    src, dst = F.col(S.SOURCE), F.col(S.DESTINATION)
    if ignore_case:
        # case-insensitive comparison through a collation (binary is the default)
        src, dst = F.collate(src, "UTF8_LCASE"), F.collate(dst, "UTF8_LCASE")
    return (src == F.lit(source)) & (dst == F.lit(destination))


def _of_route(df: DataFrame, source: str, destination: str, ignore_case: bool) -> DataFrame:
    """The route's rows; a table laid out by route opens its bucket's files only.
    (Cities in other letters hash to other buckets, so ``ignore_case`` reads all.)"""
    files = df if ignore_case else rows_of_bucket(df, source, destination)
    return files.where(_route_filter(source, destination, ignore_case))


def route_rows(df: DataFrame, source: str, destination: str, ignore_case: bool = False) -> DataFrame:
    """All flights from ``source`` to ``destination``, search-page columns.
    ``ignore_case=True`` matches city names case-insensitively (such filters
    are evaluated after the scan rather than pushed into it)."""
    return (_of_route(df, source, destination, ignore_case)
            .select([F.col(c).alias(o) for c, o in SEARCH_COLUMNS]))


def route_rows_sql(spark, source: str, destination: str, view: str = "flights") -> DataFrame:
    """The route search as SQL text over a registered view, with the cities
    bound as named parameters (never pasted into the text). A view laid out by
    route is asked for the route's bucket as well."""
    cols = ", ".join(f"{c} AS {o}" for c, o in SEARCH_COLUMNS)
    found = bucket_column(spark.table(view).columns)
    bucket = f" AND {found[0]} = pmod(hash(:src, :dst), {found[1]})" if found else ""
    return spark.sql(f"SELECT {cols} FROM {view} WHERE Source = :src AND destination = :dst{bucket}",
                     args={"src": source, "dst": destination})


def sort_rows(rows: DataFrame, by: str = "price", duration_order: str = "minutes") -> DataFrame:
    """Sort by price, or by duration. ``duration_order="minutes"`` sorts by the
    parsed minutes; ``"text"`` sorts the duration text as text ("10h" before
    "2h"), like the original page. NULLs last; remaining ties are
    broken on every column so the order is deterministic."""
    rest = [F.asc_nulls_last(c) for c in _OUT]
    if by == "price":
        keys = [F.asc_nulls_last("Price")]
    elif by == "duration" and duration_order == "text":
        keys = [F.asc_nulls_last("Duration")]
    elif by == "duration":
        keys = [F.asc_nulls_last(duration_minutes("Duration"))]
    else:
        raise ValueError(by)
    return rows.orderBy(*keys, *rest)


def filter_airlines(rows: DataFrame, airlines: list[str] | None) -> DataFrame:
    """Keep the listed airlines; ``None`` keeps every row (the default
    selection is every airline present)."""
    if airlines is None:
        return rows
    cond = F.col("Airline").isin(list(airlines))
    if any(a is None for a in airlines):
        cond = cond | F.col("Airline").isNull()
    return rows.where(cond)


def filter_airlines_table(rows: DataFrame, listed: DataFrame, column: str = "airline") -> DataFrame:
    """:func:`filter_airlines` with the list in a table: of any length, and no value is
    written into the plan. A listed NULL keeps the rows without an airline; repeated
    values count once; an empty list keeps nothing. The list is broadcast if its bytes
    are under the bound; beyond it both sides are shuffled, and adaptive execution
    splits an airline with a large share of the rows."""
    names = listed.select(F.col(column).cast("string").alias("_listed")).distinct()
    return rows.join(bounded_broadcast(names), F.col("Airline").eqNullSafe(F.col("_listed")), "left_semi")


def mark_cheapest(rows: DataFrame, price: str = "Price") -> DataFrame:
    """Flag every row whose price equals the minimum of ``rows`` (ties all
    flagged) and add its highlight colour. The minimum is a scalar subquery,
    computed by its own partial/final aggregate and inlined as a literal."""
    low = rows.select(F.min(price)).scalar()
    marked = rows.withColumn("is_cheapest", F.coalesce(F.col(price) == low, F.lit(False)))
    # read the flag column (not the expression again), so the subquery runs once
    return marked.withColumn(
        "highlight", F.when(F.col("is_cheapest"), F.lit(CHEAPEST_COLOUR)).otherwise(F.lit("")))


def search_flights(df: DataFrame, source: str, destination: str, sort: str = "price",
                   airlines: list[str] | None = None, duration_order: str = "minutes",
                   ignore_case: bool = False) -> DataFrame:
    """The search page: route filter -> sort -> airline filter -> cheapest."""
    rows = filter_airlines(route_rows(df, source, destination, ignore_case), airlines)
    return sort_rows(mark_cheapest(rows), sort, duration_order)


def search_summary(df: DataFrame, source: str, destination: str, ignore_case: bool = False) -> DataFrame:
    """Row count and cheapest price over the whole route (before any airline
    filter), plus the banner text."""
    agg = (_of_route(df, source, destination, ignore_case)
           .agg(F.count(F.lit(1)).alias("flights_found"),
                F.min(S.PRICE).alias("cheapest_price")))
    banner = F.when(
        F.col("flights_found") > 0,
        F.format_string(FOUND_BANNER, F.col("flights_found"), F.col("cheapest_price")),
    ).otherwise(F.lit(EMPTY_BANNER))
    return agg.withColumn("banner", banner)


def search_airlines(df: DataFrame, source: str, destination: str) -> DataFrame:
    """Distinct airlines present in a route's result."""
    return route_rows(df, source, destination).select("Airline").distinct().orderBy(F.asc_nulls_last("Airline"))


def distinct_cities(df: DataFrame) -> DataFrame:
    """Option lists for the search page: distinct sources and destinations
    (a NULL is kept as its own value), alphabetical."""
    # one scan: each row yields its two (side, city) pairs, then one distinct
    # (partial aggregation before the shuffle)
    pairs = F.explode(F.array(
        F.struct(F.lit("source").alias("side"), F.col(S.SOURCE).alias("city")),
        F.struct(F.lit("destination").alias("side"), F.col(S.DESTINATION).alias("city")),
    )).alias("p")
    return (df.select(pairs).select("p.side", "p.city").distinct()
            .orderBy("side", F.asc_nulls_last("city")))
