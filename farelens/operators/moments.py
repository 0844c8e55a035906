"""Per-group statistics kept as mergeable moments, one set a batch of rows.

The moments of a group are its size n, and per measure the sum and M2, the sum of
squared deviations from the mean. They merge (Chan, Golub and LeVeque), so an
ingest computes them for the new rows only, writes them under its batch id, and the
statistics of the whole table follow from one small row per group and batch.
A merge never subtracts large sums of squares, which the sum-of-squares form does, and
means of whole numbers have the bits of a full pass, since their sums are exact.

Defined results: rows without a group key or without any of the measures are not
counted, as in the full pass; a group of one row has no standard deviation; a batch
without such rows adds nothing; the same batch id written again replaces its rows,
so that a repeated ingest counts them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.operators.outliers import GROUP, MEASURES, clean, outlier_input

BATCH = "batch"


def _parts(short: str) -> tuple[str, str]:
    return f"{short}_sum", f"{short}_m2"


def group_moments(df: DataFrame, by: str = GROUP, measures: dict[str, str] = MEASURES,
                  batch: str | None = None) -> DataFrame:
    """(by[, batch], n, <short>_sum, <short>_m2, ...) of complete rows. Each task sends
    one row a group, so a hot group is not gathered."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for col, short in measures.items():
        total, m2 = _parts(short)
        aggs += [F.sum(F.col(col).cast("double")).alias(total), (F.var_pop(col) * F.count(F.lit(1))).alias(m2)]
    return df.where(F.col(by).isNotNull()).groupBy(by, *([batch] if batch else [])).agg(*aggs)


def _merge(a: Column, b: Column, measures: dict[str, str]) -> Column:
    """The moments of two disjoint sets of rows together; ``b`` is not empty, ``a`` at first."""
    n = a["n"] + b["n"]
    out = [n.alias("n")]
    for short in measures.values():
        total, m2 = _parts(short)
        d = b[total] / b["n"] - a[total] / F.greatest(a["n"], F.lit(1))
        out += [(a[total] + b[total]).alias(total),
                (a[m2] + b[m2] + d * d * (a["n"].cast("double") * b["n"] / n)).alias(m2)]
    return F.struct(*out)


def merge_moments(moments: DataFrame, by: str = GROUP, measures: dict[str, str] = MEASURES,
                  batch: str = BATCH) -> DataFrame:
    """One set of moments a group, folded pairwise in the order of the batches, so that
    a rerun gives the same bits. A group's list holds one row a batch it occurs in."""
    fields = ["n"] + [c for short in measures.values() for c in _parts(short)]
    rows = F.array_sort(F.collect_list(F.struct(batch, *fields)))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(c) for c in fields[1:]])
    merged = F.aggregate("_rows", zero, lambda a, b: _merge(a, b, measures))
    return (moments.groupBy(by).agg(rows.alias("_rows")).select(by, merged.alias("_m"))
            .select(by, *[F.col(f"_m.{c}").alias(c) for c in fields]))


def stats_of(moments: DataFrame, by: str = GROUP, measures: dict[str, str] = MEASURES) -> DataFrame:
    """The columns of :func:`farelens.operators.outliers.group_stats`."""
    out = [F.col(by)]
    for short in measures.values():
        total, m2 = _parts(short)
        out += [(F.col(total) / F.col("n")).alias(f"{short}_mean"), F.when(F.col("n") > 1, F.sqrt(F.col(m2) / (F.col("n") - 1))).alias(f"{short}_std")]
    return moments.select(*out, F.col("n").alias("route_size"))


def append_moments(flights: DataFrame, path: str, batch_id: str) -> None:
    """Write the moments of a batch of fares below ``path`` (shared storage)."""
    if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
        raise ValueError("a batch id has letters, digits, '-' and '_'")
    (group_moments(clean(outlier_input(flights))).withColumn(BATCH, F.lit(batch_id))
     .write.mode("overwrite").parquet(f"{path}/moments-{batch_id}"))


def stored_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of all batches written below ``path``, to be given to
    :func:`farelens.operators.outliers.detect`. No fare row is read."""
    return stats_of(merge_moments(spark.read.parquet(f"{path}/moments-*")))
