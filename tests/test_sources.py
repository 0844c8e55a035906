"""Sources: materialisation, loading and the star-schema derivation."""

import datetime as dt
import os
import threading

import pytest

from farelens import schema as S
from farelens.sources import load_flights, materialize


def _rows():
    return [("A", dt.date(2019, 1, 1), "X", "Y", "X-Y", "10:00:00", "12:00:00", "2h", "non-stop", 100)]


def test_materialize_writes_once_and_concurrently(spark, tmp_path):
    df = spark.createDataFrame(_rows() * 5, S.FLIGHTS)
    target = str(tmp_path / "tables" / "t1")
    results = []

    def work():
        results.append(materialize(df, target, sort_within=[S.SOURCE], if_exists="reuse").count())

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results == [5, 5, 5]
    assert os.path.exists(os.path.join(target, "_SUCCESS"))
    assert not [p for p in os.listdir(tmp_path / "tables") if ".tmp-" in p]


def test_a_second_ingest_never_returns_old_rows(spark, tmp_path):
    from farelens.sources import ingest_flights
    one, two = spark.createDataFrame(_rows(), S.FLIGHTS), spark.createDataFrame(_rows() * 2, S.FLIGHTS)
    path = str(tmp_path / "t")
    assert ingest_flights(one, path).count() == 1
    with pytest.raises(FileExistsError):
        ingest_flights(two, path)
    assert ingest_flights(two, path, if_exists="replace").count() == 2


def test_malformed_csv_ends_the_read(spark, tmp_path):
    good = "airline,date_of_journey,Source,destination,route,dep_time,Arrival_time,Duration,Total_stops,Price\n"
    for row in ("A,24/03/2019,X,Y,X-Y,10:00:00,12:00:00,2h,non-stop,100\n",
                "A,2019-03-24,X,Y,X-Y,10:00:00,12:00:00,2h,non-stop,5000.0\n"):
        (tmp_path / "bad.csv").write_text(good + row)
        with pytest.raises(Exception, match="MALFORMED"):
            load_flights(spark, str(tmp_path / "bad.csv"), fmt="csv").collect()


def test_loading_an_ingested_table_keeps_the_parsed_columns(spark, tmp_path):
    from farelens.sources import ingest_flights
    ingest_flights(spark.createDataFrame(_rows(), S.FLIGHTS), str(tmp_path / "t"))
    again = load_flights(spark, str(tmp_path / "t"))
    assert again.columns[:-1] == S.FLIGHT_COLUMNS + ["duration_minutes", "stops_num"]
    assert again.columns[-1].startswith("route_bucket_")


def test_jdbc_reads_are_split(spark):
    from farelens.sources import jdbc_partitions
    assert jdbc_partitions("id", 1, 9_500_000, 9_500_000) == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "9500000", "numPartitions": "10"}
    assert jdbc_partitions("day", "2019-01-01", "2019-12-31", 0)["numPartitions"] == "1"
    with pytest.raises(ValueError, match="partitionColumn"):
        load_flights(spark, fmt="jdbc", options={"url": "jdbc:x", "dbtable": "flights"})


def test_a_rewritten_file_of_equal_size_is_another_input(spark, tmp_path):
    import time
    from farelens.sources.flights import _input_fingerprint
    d = tmp_path / "nation.parquet"
    d.mkdir()
    (d / "part-0.parquet").write_bytes(b"aaaa")
    first = _input_fingerprint(spark, str(tmp_path))
    time.sleep(1.1)
    (d / "part-0.parquet").write_bytes(b"bbbb")
    assert _input_fingerprint(spark, str(tmp_path)) != first


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace
    from farelens.session import scratch_root
    ctx = SimpleNamespace(master="spark://host:7077", applicationId="app-x", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=ctx)
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch_root(session)


def test_load_flights_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame(_rows(), S.FLIGHTS)
    df.write.option("header", "true").csv(str(tmp_path / "csv"))
    df.write.parquet(str(tmp_path / "pq"))
    for fmt, path in (("csv", "csv"), ("parquet", "pq")):
        got = load_flights(spark, str(tmp_path / path), fmt=fmt)
        assert got.schema == S.FLIGHTS
        assert [tuple(r) for r in got.collect()] == _rows()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test data not present")
def test_star_derivation_shape(spark):
    from farelens.sources import flights_from_star, flights_table
    raw = flights_from_star(spark, "/root/testdata/sf0.001")
    assert raw.columns == S.FLIGHT_COLUMNS
    stored = flights_table(spark, "/root/testdata/sf0.001")
    assert stored.columns[:-1] == S.FLIGHT_COLUMNS + ["duration_minutes", "stops_num"]
    assert stored.columns[-1].startswith("route_bucket_")       # the partition column
    assert stored.count() == raw.count() == 6000


def test_ingest_parses_once(spark, tmp_path):
    from farelens.sources import ingest_flights
    df = spark.createDataFrame(_rows() + [("B", dt.date(2019, 1, 2), "X", "Y", "X-Y", "10:00:00",
                                             "13:00:00", None, "2 stops", 200)], S.FLIGHTS)
    got = ingest_flights(df, str(tmp_path / "ing")).orderBy("airline").collect()
    assert [(r["duration_minutes"], r["stops_num"]) for r in got] == [(120.0, 0), (None, 2)]
