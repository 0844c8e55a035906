"""Result helpers: a bounded JSON sample of a result and the chart choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 20
BAR_MAX_ROWS = 15

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType, T.BooleanType)


def sample_json(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows of ``df`` (in its own order), one JSON object per
    row with its 1-based position. The limit bounds the work: at most ``n``
    records are gathered into one array, sorted by their arrival id and
    exploded with their position (no window operator)."""
    head = df.limit(n).select(F.monotonically_increasing_id().alias("_mono"),
                              F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))
    ordered = head.agg(F.array_sort(F.collect_list(F.struct("_mono", "record"))).alias("_rows"))
    return (ordered.select(F.posexplode("_rows").alias("_pos", "_row"))
            .select((F.col("_pos") + 1).alias("rn"), F.col("_row.record").alias("record")))


def chart_kind_column(df: DataFrame) -> DataFrame:
    """One-row DataFrame with the chart kind for ``df``: ``none`` when it has
    fewer than two columns, no rows, or a non-numeric second column; ``bar``
    for at most 15 rows; ``line`` otherwise. At most 16 rows are counted."""
    if len(df.columns) < 2 or not isinstance(df.schema.fields[1].dataType, _NUMERIC):
        # decided by the schema alone: no need to compute the result
        return df.sparkSession.range(1, numPartitions=1).select(F.lit("none").alias("chart_kind"))
    n = F.count(F.lit(1))
    kind = (F.when(n == 0, F.lit("none"))
            .when(n <= BAR_MAX_ROWS, F.lit("bar"))
            .otherwise(F.lit("line")))
    return df.limit(BAR_MAX_ROWS + 1).agg(kind.alias("chart_kind"))


def chart_kind(df: DataFrame) -> str:
    """The chart kind as a Python string (one bounded job)."""
    return chart_kind_column(df).first()[0]
