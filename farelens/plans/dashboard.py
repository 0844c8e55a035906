"""Page-level compositions: the analytics dashboard and the home counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens import schema as S
from farelens.functions.text import ARROW_UNICODE, currency, od_route, pair_route
from farelens.operators import metrics as M
from farelens.operators import profile as P
from farelens.session import scratch_root


def kpi_labels(df: DataFrame) -> DataFrame:
    """The four KPI cards as (label, value) text rows, from one aggregate."""
    k = M.kpi_bundle(df)
    return k.select(F.explode(F.array(
        F.struct(F.lit("Total Flights").alias("label"), F.col("total_flights").cast("string").alias("value")),
        F.struct(F.lit("Total Airlines").alias("label"), F.col("total_airlines").cast("string").alias("value")),
        F.struct(F.lit("Total Routes").alias("label"), F.col("total_routes").cast("string").alias("value")),
        F.struct(F.lit("Avg Price").alias("label"), currency(F.col("avg_price")).alias("value")),
    )).alias("card")).select("card.label", "card.value")


def home_counts(df: DataFrame) -> DataFrame:
    """Home page: records, airlines, routes and cities covered, one pass.
    Cities counts distinct sources with a NULL source counted as one more
    value (a DISTINCT list keeps the NULL row)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(S.AIRLINE).alias("airlines_covered"),
        F.count_distinct(pair_route()).alias("unique_routes"),
        (F.count_distinct(S.SOURCE)
         + F.coalesce(F.max(F.col(S.SOURCE).isNull().cast("int")), F.lit(0))).cast("bigint")
        .alias("cities_covered"),
    )


# feed name -> grouping key; "all" is the grand total (empty grouping set)
def _feed_keys() -> dict[str, object]:
    return {
        "airline": F.col(S.AIRLINE),
        "airport": F.col(S.SOURCE),
        "month": F.date_format(F.col(S.DATE), "yyyy-MM"),
        "year": F.year(F.col(S.DATE)).cast("string"),
        "od_route": od_route(ARROW_UNICODE),
        "pair_route": pair_route(),
    }


FEEDS = ("airline", "airport", "month", "year", "od_route", "pair_route")


def dashboard_feeds(df: DataFrame) -> DataFrame:
    """Every count the analytics page needs, from one scan.

    One GROUPING SETS aggregate over six keys plus the grand total: the rows
    are expanded in memory before partial aggregation, so the fact table is
    read once and only per-task partial groups are shuffled. Output:
    (feed, key, flights, price_sum, price_n), one row per group per feed.
    """
    keys = _feed_keys()
    base = df.select(*[expr.alias(f"_k_{name}") for name, expr in keys.items()], F.col(S.PRICE))
    cols = [f"_k_{name}" for name in FEEDS]
    n = len(cols)
    grouped = base.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        F.count(F.lit(1)).alias("flights"),
        F.sum(S.PRICE).cast("bigint").alias("price_sum"),
        F.count(S.PRICE).alias("price_n"),
        F.grouping_id().alias("_gid"),
    )
    # grouping_id has a 1 bit for every column left out; the first column is
    # the most significant bit
    feed = F.lit("all")
    for i, name in enumerate(FEEDS):
        feed = F.when(F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1 - i), F.lit(name)).otherwise(feed)
    return grouped.select(feed.alias("feed"), F.coalesce(*[F.col(c) for c in cols]).alias("key"),
                          "flights", "price_sum", "price_n")


def dashboard(df: DataFrame, one_pass: bool = True) -> dict[str, DataFrame]:
    """The analytics page: KPI numbers plus six chart feeds.

    ``one_pass=True`` computes :func:`dashboard_feeds` once (one scan of the
    fact table), checkpoints that small result to the shared folder and
    derives every card and chart from it. ``one_pass=False`` returns the
    independent lazy plans (one scan each).
    """
    if not one_pass:
        return {
            "kpis": M.kpi_bundle(df),
            "flights_per_airline": P.freq_airline_share(df),
            "avg_price_per_airline": P.avg_price_airline_chart(df),
            "busiest_airports": P.freq_airport(df),
            "top_routes": P.top_routes(df),
            "flights_per_month": P.freq_month(df),
            "flights_per_year": P.freq_year(df),
        }
    scratch_root(df.sparkSession)
    feeds = dashboard_feeds(df).checkpoint(eager=True)

    def feed(name: str) -> DataFrame:
        return feeds.where(F.col("feed") == name)

    is_all = F.col("feed") == "all"
    kpis = feeds.agg(
        F.coalesce(F.sum(F.when(is_all, F.col("flights"))), F.lit(0)).cast("bigint").alias("total_flights"),
        F.count_if((F.col("feed") == "airline") & F.col("key").isNotNull()).alias("total_airlines"),
        F.count_if((F.col("feed") == "pair_route") & F.col("key").isNotNull()).alias("total_routes"),
        F.round(F.sum(F.when(is_all, F.col("price_sum"))) / F.sum(F.when(is_all, F.col("price_n"))), 0)
        .alias("avg_price"),
    )
    airline = feed("airline").select(F.col("key").alias(S.AIRLINE), "flights", "price_sum", "price_n")
    mean = F.col("price_sum") / F.col("price_n")
    return {
        "kpis": kpis,
        "flights_per_airline": P.share_of_total(airline.select(S.AIRLINE, "flights")),
        "avg_price_per_airline": (airline.orderBy(F.desc_nulls_last(mean), F.asc_nulls_last(S.AIRLINE))
                                  .select(S.AIRLINE, F.round(mean, 0).alias("avg_price"))),
        "busiest_airports": (feed("airport").select(F.col("key").alias("airport"), "flights")
                             .orderBy(F.desc("flights"), F.asc_nulls_last("airport"))),
        "top_routes": P.top_k(feed("od_route").select(F.col("key").alias(S.OD_ROUTE), "flights"),
                              10, "flights", S.OD_ROUTE),
        "flights_per_month": feed("month").select(F.col("key").alias("month"), "flights").orderBy("month"),
        "flights_per_year": (feed("year").select(F.col("key").cast("int").alias("year"), "flights")
                             .orderBy("year")),
    }
