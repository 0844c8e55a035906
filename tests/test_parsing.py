"""Duration and stop-count parsing (cases of the original unit tests plus
rules-derived cases)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.functions.parsing import duration_minutes, stops_num


def _apply(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("t", T.StringType())]))
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


# The first cases of each list are the documented examples.
DURATIONS = [
    ("2h 50m", 170.0), ("5h", 300.0), ("45m", 45.0), (None, None), ("2H 30M", 150.0),
    ("2.5h", 300.0), ("1h30", 60.0), ("90 mins", 90.0), ("170", 170.0), ("", None), ("abc", None),
    ("  3h 5m  ", 185.0), ("170d", None), ("1_000", None), ("inf", None), ("nan", None),
    ("12.5", 12.5), ("1e2", 100.0),
    ("12345678901h", 740740734060.0), ("9" * 25 + "h", None), ("9" * 25 + "h 5m", 5.0),
    ("200000000000000000h", 1.2e19),
]


@pytest.mark.parametrize("text,expected", DURATIONS)
def test_duration(spark, text, expected):
    assert _apply(spark, duration_minutes, [text]) == [expected]


STOPS = [("non-stop", 0), ("1 stop", 1), ("2 stops", 2), (None, None), ("Nonstop", 0),
         ("one-stop", None), ("Non-Stop", 0), ("  3 stops", 3),
         ("99999999999 stops", None), ("9" * 25, None), ("2147483647", 2147483647), ("2147483648", None)]


@pytest.mark.parametrize("text,expected", STOPS)
def test_stops(spark, text, expected):
    assert _apply(spark, stops_num, [text]) == [expected]


def test_parse_has_no_python_udf(spark):
    df = spark.createDataFrame([("2h 5m", "1 stop")], "d string, s string")
    plan = df.select(duration_minutes("d"), stops_num("s"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
