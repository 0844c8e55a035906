"""The layout of a written fare table: partitions by a hash of the route.

A partition column ``route_bucket_<n>`` holds the hash of (Source, destination)
modulo n, so a search for one route reads the files of one bucket and doesn't even
open the others. Its name carries n: a reader needs no further description, and
tables written with different n can live side by side. n grows with the table's
size (one bucket per target file), up to ``MAX_BUCKETS``; beyond that a bucket has
several files, each of them sorted by route, and row groups are skipped in them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens import schema as S

PREFIX = "route_bucket_"
# The most folders that a table is listed by; at 256 MB a file, this many are a TB.
MAX_BUCKETS = 4096


def bucket_name(buckets: int) -> str:
    return f"{PREFIX}{buckets}"


def route_bucket(source: Column, destination: Column, buckets: int) -> Column:
    """The bucket of a route; a null city has one as well."""
    return F.pmod(F.hash(source, destination), F.lit(buckets))


def bucket_column(columns: list[str]) -> tuple[str, int] | None:
    """Name and number of buckets, if the table is laid out by route."""
    for name in columns:
        found = re.fullmatch(PREFIX + r"([1-9][0-9]*)", name)
        if found:
            return name, int(found[1])
    return None


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    old = bucket_column(df.columns)
    df = df.drop(old[0]) if old else df
    return df.withColumn(bucket_name(buckets), route_bucket(F.col(S.SOURCE), F.col(S.DESTINATION), buckets))


def rows_of_bucket(df: DataFrame, source: str, destination: str) -> DataFrame:
    """The files that may hold a route. The bucket of two literals is a constant
    for the optimizer and becomes a partition filter; a table without buckets
    stays as it is."""
    found = bucket_column(df.columns)
    if not found:
        return df
    return df.where(F.col(found[0]) == route_bucket(F.lit(source), F.lit(destination), found[1]))
