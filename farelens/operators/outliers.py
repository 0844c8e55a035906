"""Per-group outlier detection with severity scoring and a ranked report.

Plan shape (README, "Designed for scale"): the text columns are parsed once
(at ingest when the table stores the parsed columns), incomplete rows are
dropped, mean / sample std / size are aggregated per group (partial
aggregation before the shuffle, so a hot group costs one row per task), and
those per-group rows are joined back. The stats are checkpointed and measured;
under a fixed byte bound they are broadcast and the rows are never shuffled,
above it the join is a sort-merge join whose skewed groups AQE splits. No
per-group window, so no single task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.parsing import with_parsed
from farelens.functions.text import RUPEE, half_even_text
from farelens.plans.strategy import bounded_broadcast, within_bytes
from farelens.session import scratch_root

# Detector defaults, severity labels and display colours.
Z_THRESHOLD = 2.0
MIN_GROUP_SIZE = 5
TOP_N = 8
SEVERITY_LABELS = {1: "Low", 2: "Medium", 3: "High"}
SEVERITY_COLOURS = {"High": "#f8d7da", "Medium": "#fff3cd", "Low": "#d4edda"}

# The most per-group stats that are sent to every executor, in bytes: the group
# key may be any text, so a row count would not bound it.
STATS_BROADCAST_BYTES = 64 * 1024 * 1024

# measure column -> short name used in derived columns
MEASURES = {"Price": "price", "duration_minutes": "duration", "stops_num": "stops"}
GROUP = "Route"


PARSED = ("duration_minutes", "stops_num")


def outlier_input(flights: DataFrame) -> DataFrame:
    """The five detector columns of a fare table, under their report names
    (plus the parsed measures when the table already stores them)."""
    cols = [F.col("airline").alias("Airline"), F.col("route").alias("Route"),
            F.col("Price"), F.col("Duration"), F.col("Total_stops")]
    if all(c in flights.columns for c in PARSED):
        cols += [F.col(c) for c in PARSED]
    return flights.select(*cols)


def clean(df: DataFrame) -> DataFrame:
    """Parse duration and stops (unless already parsed at ingest), then drop
    rows missing any measure."""
    if not all(c in df.columns for c in PARSED):
        df = with_parsed(df)
    return df.dropna(subset=list(MEASURES))


def group_stats(df: DataFrame, by: str = GROUP, measures: dict[str, str] = MEASURES) -> DataFrame:
    """Mean, sample standard deviation and size per group (NULL keys dropped)."""
    aggs = []
    for col, short in measures.items():
        aggs += [F.avg(col).alias(f"{short}_mean"), F.stddev_samp(col).alias(f"{short}_std")]
    aggs.append(F.count(F.lit(1)).alias("route_size"))
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs)


def _safe_z(x: Column, mean: Column, sd: Column) -> Column:
    # undefined (one row) or zero spread -> 0, never NaN or infinity
    z = (x.cast("double") - mean) / F.nullif(sd, F.lit(0.0))
    return F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0))


def attachable_stats(stats: DataFrame, broadcast_max_bytes: int | None = STATS_BROADCAST_BYTES) -> DataFrame:
    """Make the per-group stats ready to join back onto the rows.

    The planner cannot know how many groups an aggregate yields, so it would
    plan a shuffle join and move every row across the network. Instead the
    stats are computed once and checkpointed to the shared checkpoint folder
    (cutting their lineage), their bytes are summed, and they are broadcast
    only when that sum is under ``broadcast_max_bytes``; beyond it
    :func:`group_zscores` deals hot groups out over several tasks
    (:func:`spread_join`). ``None`` leaves the choice to the planner (for small,
    one-off inputs).
    """
    if broadcast_max_bytes is None:
        return stats
    scratch_root(stats.sparkSession)          # make sure a checkpoint folder is set
    return stats.checkpoint(eager=True)


def spread_join(rows: DataFrame, stats: DataFrame, by: str, total: int, tasks: int) -> DataFrame:
    """``rows`` joined with their group's ``stats`` where a group may hold a large
    share of all rows. Groups with more than total / tasks rows, of which there
    are less than ``tasks``, are dealt out over several parts; their stats row is in
    each part. The sizes are those that the stats hold, so nothing is counted again;
    without such groups it is a plain join."""
    share = max(1, -(-total // tasks))
    hot = (stats.where(F.col("route_size") > share)
           .select(by, F.ceil(F.col("route_size") / share).cast("int").alias("_parts")))
    if not hot.limit(1).count():
        return rows.join(stats, by)
    hot = bounded_broadcast(hot)
    one = F.coalesce("_parts", F.lit(1))
    dealt = (rows.join(hot, by, "left")
             .withColumn("_part", F.pmod(F.monotonically_increasing_id(), one).cast("int")).drop("_parts"))
    each = (stats.join(hot, by, "left")
            .withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts"))
    return dealt.join(each, [by, "_part"]).drop("_part")


def group_zscores(df: DataFrame, by: str = GROUP, measures: dict[str, str] = MEASURES,
                  broadcast_max_bytes: int | None = STATS_BROADCAST_BYTES,
                  stats: DataFrame | None = None) -> DataFrame:
    """Attach group stats and a z-score per measure to every row. ``stats`` are those
    of ``df`` unless given, for instance from stored moments
    (:mod:`farelens.operators.moments`); rows of a group without stats are left out."""
    stats = attachable_stats(group_stats(df, by, measures) if stats is None else stats, broadcast_max_bytes)
    rows = df.where(F.col(by).isNotNull())
    if broadcast_max_bytes is None or within_bytes(stats, broadcast_max_bytes):
        out = rows.join(stats if broadcast_max_bytes is None else F.broadcast(stats), by)
    else:
        total = stats.agg(F.sum("route_size")).first()[0] or 0
        # four parts a task, so that they even out
        out = spread_join(rows, stats, by, total, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for col, short in measures.items():
        out = out.withColumn(f"{short}_z", _safe_z(F.col(col), F.col(f"{short}_mean"), F.col(f"{short}_std")))
    for col, short in measures.items():
        out = out.withColumn(f"route_avg_{short}", F.col(f"{short}_mean"))
    return out


def flag_outliers(df: DataFrame, threshold: float = Z_THRESHOLD,
                  min_size: int = MIN_GROUP_SIZE, measures: dict[str, str] = MEASURES) -> DataFrame:
    """Size filter -> strict |z| > threshold flags -> severity = number of
    flags -> keep severity >= 1 -> max |z| -> label and colour."""
    out = df.where(F.col("route_size") >= min_size)
    flags = []
    for short in measures.values():
        flag = F.abs(F.col(f"{short}_z")) > F.lit(float(threshold))
        out = out.withColumn(f"{short}_flag", flag)
        flags.append(F.col(f"{short}_flag").cast("int"))
    score = flags[0]
    for f in flags[1:]:
        score = score + f
    out = out.withColumn("severity_score", score).where(F.col("severity_score") >= 1)
    out = out.withColumn("max_abs_z", F.greatest(*[F.abs(F.col(f"{s}_z")) for s in measures.values()]))
    label = F.lit(None).cast("string")
    for score_value, name in sorted(SEVERITY_LABELS.items()):
        label = F.when(F.col("severity_score") == score_value, F.lit(name)).otherwise(label)
    out = out.withColumn("Severity", label)
    colour = F.lit(None).cast("string")
    for name, hex_ in SEVERITY_COLOURS.items():
        colour = F.when(F.col("Severity") == name, F.lit(hex_)).otherwise(colour)
    return out.withColumn("highlight", colour)


def detect(flights: DataFrame, threshold: float = Z_THRESHOLD, min_size: int = MIN_GROUP_SIZE,
           broadcast_max_bytes: int | None = STATS_BROADCAST_BYTES,
           stats: DataFrame | None = None) -> DataFrame:
    """All flagged rows of a fare table (unordered, not capped)."""
    z = group_zscores(clean(outlier_input(flights)), broadcast_max_bytes=broadcast_max_bytes, stats=stats)
    return flag_outliers(z, threshold, min_size)


# rank order, with every remaining column as a tie-break so top-n is stable
def rank_order() -> list[Column]:
    return [F.desc("severity_score"), F.desc("max_abs_z"), F.asc_nulls_last("Airline"),
            F.asc_nulls_last("Route"), F.asc_nulls_last("Price"),
            F.asc_nulls_last("duration_minutes"), F.asc_nulls_last("stops_num"),
            F.asc_nulls_last("Duration"), F.asc_nulls_last("Total_stops")]


def narrative(df: DataFrame) -> Column:
    """Plain-text facts for one flagged row: the row's numbers next to its
    group's averages. Numbers are rounded half to even, like Python's
    fixed-point formatting."""
    return F.concat(
        F.lit("Route "), F.col("Route"), F.lit(": price "), F.lit(RUPEE),
        half_even_text(F.col("Price").cast("double"), 0),
        F.lit(" vs route average "), F.lit(RUPEE), half_even_text(F.col("route_avg_price"), 0),
        F.lit("; duration "), half_even_text(F.col("duration_minutes"), 0),
        F.lit(" min vs "), half_even_text(F.col("route_avg_duration"), 0),
        F.lit(" min; stops "), half_even_text(F.col("stops_num").cast("double"), 0),
        F.lit(" vs "), half_even_text(F.col("route_avg_stops"), 1),
        F.lit(" (based on "), F.col("route_size").cast("string"), F.lit(" flights)."),
    )


def with_narrative(flagged: DataFrame) -> DataFrame:
    return flagged.withColumn("explanation", narrative(flagged))


def report(flagged: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """The ranked report: top ``top_n`` flagged rows with display columns.
    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps
    its own top n and only n rows per task reach the final merge. The text is
    made for these rows alone."""
    top = with_narrative(flagged.orderBy(*rank_order()).limit(top_n))
    return top.select(
        "Airline", "Route", "Price",
        F.bround("duration_minutes", 0).cast("int").alias("duration_min"),
        F.bround("stops_num", 0).cast("int").alias("stops"),
        "Severity",
        F.bround("price_z", 2).alias("price_z"),
        F.bround("duration_z", 2).alias("duration_z"),
        F.bround("stops_z", 2).alias("stops_z"),
        "explanation", "highlight",
    )


def outlier_report(flights: DataFrame, top_n: int = TOP_N, threshold: float = Z_THRESHOLD,
                   min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Fare table -> ranked report in one call (detect, then report)."""
    return report(detect(flights, threshold, min_size), top_n)


def outlier_alerts(flights: DataFrame, top_n: int = TOP_N, threshold: float = Z_THRESHOLD,
                   min_size: int = MIN_GROUP_SIZE) -> dict[str, DataFrame]:
    """The alerts page: ranked report, per-severity counts and the narrative
    for every flagged row, all from one detection (the per-route stats are
    computed and checkpointed once and shared by the three results)."""
    flagged = detect(flights, threshold, min_size)
    return {"report": report(flagged, top_n), "counts": severity_counts(flagged, top_n),
            "narrative": with_narrative(flagged).select("Airline", "Route", "Price", "Severity", "explanation")}


def severity_counts(flagged: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """One row: flagged rows per severity, the uncapped total, and how many
    the capped report shows."""
    s = F.col("severity_score")
    return flagged.agg(
        F.count(F.lit(1)).alias("flagged_total"),
        F.count_if(s == 1).alias("low"),
        F.count_if(s == 2).alias("medium"),
        F.count_if(s == 3).alias("high"),
    ).withColumn("reported", F.least(F.col("flagged_total"), F.lit(top_n).cast("bigint")))
