"""Text-to-number cleaning for durations and stop counts.

Pure Spark expressions (no Python UDF), so they stay inside whole-stage
codegen. Rules:

duration: NULL stays NULL. The text is stripped and lower-cased. The first
``<digits> h`` anywhere gives hours and the first ``<digits> m`` gives minutes,
independently; when at least one is present the result is hours*60+minutes
with a missing part counting 0 ("2.5h" -> 300, "1h30" -> 60). When neither is
present the whole text is read as a plain decimal number ("170" -> 170.0);
anything else is NULL.

stops: NULL stays NULL; text containing "non" is 0; otherwise the first run
of digits; otherwise NULL. A number beyond 64 bits (hours, minutes) or 32 bits
(stops) counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A plain decimal literal. Spelled out so every engine accepts the same
# strings: no 170d/170f suffixes, no 1_000 separators, no inf/nan words.
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"


# The characters Python's str.strip() removes, derived from the rule rather
# than listed. Trimming with btrim is a plain character scan, far cheaper
# than an anchored regexp_replace.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


# The same set as a Java regex character class, so "\s" in a rule means what
# it means in Python (Java's \s alone is ASCII-only).
PY_SPACE = "[" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WHITESPACE) + "]"


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading and trailing whitespace."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def _first_int(text: Column, pattern: str, kind: str = "bigint") -> Column:
    # regexp_extract gives '' when nothing matches, and try_cast of '' or of a
    # number too long for ``kind`` is NULL: no text can end the job.
    # The extract is referenced once, so it is evaluated once per row.
    return F.regexp_extract(text, pattern, 1).try_cast(kind)


_HOURS = rf"([0-9]+){PY_SPACE}*h"
_MINUTES = rf"([0-9]+){PY_SPACE}*m"


def _combine(raw: Column, hours: Column, minutes: Column) -> Column:
    # Stripping cannot change a regex search for "<digits>h" anywhere, so it
    # is applied only in the plain-number branch.
    number = py_strip(F.lower(raw))
    as_number = F.when(number.rlike(_DECIMAL), number.try_cast("double"))
    return (
        F.when(raw.isNull(), F.lit(None).cast("double"))
        .when(hours.isNull() & minutes.isNull(), as_number)
        # doubles from here on: a long number of hours can't overflow
        .otherwise(F.coalesce(hours.cast("double"), F.lit(0.0)) * 60 + F.coalesce(minutes.cast("double"), F.lit(0.0)))
    )


def duration_minutes(c: Column | str) -> Column:
    """Duration text -> minutes as double (one expression; see
    :func:`with_parsed` for the cheaper staged form over a DataFrame)."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.lower(c)
    return _combine(c, _first_int(text, _HOURS), _first_int(text, _MINUTES))


def stops_num(c: Column | str) -> Column:
    """Stops text -> number of stops as int."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.lower(c)   # stripping cannot change a substring or digit search
    return (
        F.when(c.isNull(), F.lit(None).cast("int"))
        .when(text.contains("non"), F.lit(0))
        .otherwise(_first_int(text, r"([0-9]+)", "int"))
    )


def with_parsed(df: DataFrame, duration: str = "Duration", stops: str = "Total_stops",
                duration_out: str = "duration_minutes", stops_out: str = "stops_num") -> DataFrame:
    """Add parsed duration and stops columns, evaluating each regex once.

    The hour and minute extracts get their own projection; Catalyst does not
    inline a non-trivial expression into a consumer that references it twice,
    so each regex runs once per row instead of once per reference.
    """
    text = F.lower(F.col(duration))
    staged = df.select("*", _first_int(text, _HOURS).alias("_dur_h"),
                       _first_int(text, _MINUTES).alias("_dur_m"))
    return staged.select(
        *[F.col(c) for c in df.columns],
        _combine(F.col(duration), F.col("_dur_h"), F.col("_dur_m")).alias(duration_out),
        stops_num(stops).alias(stops_out),
    )
