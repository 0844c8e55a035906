"""The nine metrics as SQL table functions against the DataFrame registry."""

import datetime

import pytest
from pyspark.sql import functions as F

from farelens import schema as S
from farelens.operators.metrics import REGISTRY, run_metric
from farelens.operators.metrics_sql import METRIC_SQL, register_metrics, run_metric_sql


def _fares(spark, n=60):
    day = datetime.date(2019, 1, 1)
    rows = [(f"A{i % 4}" if i % 9 else None, day + datetime.timedelta(days=i % 20), f"C{i % 3}" if i % 7 else None, f"C{i % 5}",
             "r", "10:00:00", "12:00:00", "2h", ["non-stop", "1 stop", None][i % 3], 100 + (i * 37) % 50 if i % 11 else None)
            for i in range(n)]
    return spark.createDataFrame(rows, S.FLIGHTS)


@pytest.fixture(scope="module")
def fares(spark):
    df = _fares(spark).cache()
    df.createOrReplaceTempView("fares_sql")
    register_metrics(spark, "fares_sql")
    return df


@pytest.mark.parametrize("key", list(REGISTRY))
def test_whole_table_and_slices(spark, fares, key):
    def same(rows, **given):
        want, got = run_metric(rows, key), run_metric_sql(spark, key, "fares_sql", **given)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        assert got.collect() == want.collect()
    assert list(METRIC_SQL) == list(REGISTRY)
    day = datetime.date(2019, 1, 10)
    same(fares)
    same(fares.where((F.col("Source") == "C1") & (F.col("airline") == "A2")), from_city="C1", carrier="A2")
    same(fares.where((F.col("destination") == "C4") & (F.col("date_of_journey") >= day)), to_city="C4", first_day=day)
    same(fares.where(F.col("date_of_journey") <= day), last_day=day)
    same(fares.where(F.lit(False)), from_city="' OR 1=1 --")


def test_sql_callers_use_the_functions(spark, fares):
    got = spark.sql("SELECT m.total_flights, p.avg_price FROM fares_sql_total_flights() m CROSS JOIN fares_sql_avg_price(carrier => 'A1') p").first()
    assert got["total_flights"] == 60 and got["avg_price"] == run_metric(fares.where("airline = 'A1'"), "avg_price").first()[0]


def test_what_is_refused(spark, fares):
    with pytest.raises(ValueError):
        register_metrics(spark, "fares; DROP TABLE x")
    with pytest.raises(TypeError):
        run_metric_sql(spark, "avg_price", "fares_sql", airline="A1")
    with pytest.raises(KeyError):
        run_metric_sql(spark, "median_price", "fares_sql")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    _fares(spark).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("fares_file")
    register_metrics(spark, "fares_file")
    plan = run_metric_sql(spark, "avg_price", "fares_file", from_city="C1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Source,C1)" in plan and "carrier" not in plan
