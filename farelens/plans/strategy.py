"""Physical-strategy helper: the size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured bytes prove it small (the nation
# lookup; per-route stats after their checkpoint). Everything else is left to
# the planner: AQE measures the real shuffle output at run time and turns a
# sort-merge join into a broadcast join only under
# spark.sql.autoBroadcastJoinThreshold, so the sort-merge join remains the path
# for large sides.
BROADCAST_BYTES = 64 * 1024 * 1024
_FIXED_BYTES = 16       # a fixed-width value with its share of the row's overhead


def row_bytes(df: DataFrame) -> Column:
    """The size of a row in memory, about: text and binary by their length."""
    out = F.lit(_FIXED_BYTES)
    for f in df.schema.fields:
        out = out + _FIXED_BYTES
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return out.cast("bigint")


def within_bytes(df: DataFrame, max_bytes: int) -> bool:
    """Whether the rows of ``df`` take at most ``max_bytes``.

    One aggregate of partial sums, run while the plan is built and only on
    inputs that are cheap to read: a lookup table or a checkpointed aggregate.
    No row leaves its task.
    """
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if the rows of ``df`` take at most ``max_bytes``, else ``df``."""
    return F.broadcast(df) if within_bytes(df, max_bytes) else df
