"""Stored moments against a full pass, and airline lists held in a table."""

import datetime as dt
import random

import pytest

from farelens import schema as S
from farelens.operators import moments as M
from farelens.operators import outliers as O
from farelens.operators.search import filter_airlines, filter_airlines_table, route_rows


def _fares(spark, rng, n, routes):
    rows = []
    for _ in range(n):
        r = rng.choice(routes)
        # a large offset: sums of squares would lose the spread in it
        price = rng.choice([None, 100_000_000, 100_000_001, 100_000_003])
        rows.append((rng.choice(["A", "B", None]), dt.date(2019, 1, 1), "X", "Y", r, "10:00:00", "12:00:00",
                     rng.choice(["2h", "1h 5m", None, "3h"]), rng.choice(["non-stop", "1 stop", None]), price))
    return spark.createDataFrame(rows, S.FLIGHTS)


def _by_route(df):
    return {r["Route"]: r.asDict() for r in df.collect()}


def _same(a, b):
    assert a.keys() == b.keys()
    for route, x in a.items():
        assert x.keys() == b[route].keys()
        for c, v in x.items():
            w = b[route][c]
            assert (v is None) == (w is None), (route, c)
            if v is not None and c != "Route":
                # a mean near 1e8 is a double with steps of 1.5e-8; sums of squares would lose all of the spread
                assert w == pytest.approx(v, rel=1e-7), (route, c)


def test_three_appends_equal_a_full_pass(spark, tmp_path):
    rng = random.Random(7)
    path, whole = str(tmp_path / "m"), None
    # routes come and go between batches; R9 occurs in one, ONE has one row
    for k, routes in enumerate((["R1", "R2", None], ["R2", "R3"], ["R1", "R3", "R9"])):
        batch = _fares(spark, rng, 200, routes)
        if k == 0:
            batch = batch.union(spark.createDataFrame([("A", dt.date(2019, 1, 1), "X", "Y", "ONE", "10:00:00",
                                                        "12:00:00", "2h", "non-stop", 5)], S.FLIGHTS))
        whole = batch if whole is None else whole.union(batch)
        M.append_moments(batch, path, f"day-{k}")
        _same(_by_route(O.group_stats(O.clean(O.outlier_input(whole)))), _by_route(M.stored_stats(spark, path)))
    last = batch
    M.append_moments(last, path, "day-2")          # a repeated ingest counts once
    stored = M.stored_stats(spark, path)
    _same(_by_route(O.group_stats(O.clean(O.outlier_input(whole)))), _by_route(stored))
    assert _by_route(stored)["ONE"]["price_std"] is None
    assert stored.collect() == M.stored_stats(spark, path).collect()
    M.append_moments(last.limit(0), path, "empty")
    assert stored.count() == M.stored_stats(spark, path).count()
    key = ["Airline", "Route", "Price", "duration_minutes", "stops_num", "severity_score"]
    flagged = [sorted(map(str, O.detect(whole, threshold=1.2, stats=s).select(*key).collect()))
               for s in (None, stored)]
    assert flagged[0] == flagged[1] and flagged[0]


def test_batch_ids_are_names(spark, tmp_path):
    fares = _fares(spark, random.Random(1), 5, ["R1"])
    for bad in ("", "a/b", "..", "a*"):
        with pytest.raises(ValueError):
            M.append_moments(fares, str(tmp_path), bad)


def test_airline_table_equals_the_list(spark):
    rows = route_rows(_fares(spark, random.Random(3), 100, ["R1"]), "X", "Y")
    for listed in (["A"], ["A", "A", "Z"], [None], ["B", None, None], [], ["Z"]):
        table = spark.createDataFrame([(a, 1) for a in listed], "airline string, Price int")
        got = sorted(map(str, filter_airlines_table(rows, table).collect()))
        assert got == sorted(map(str, filter_airlines(rows, listed).collect())), listed


def test_a_long_airline_table_is_not_in_the_plan(spark):
    rows = route_rows(_fares(spark, random.Random(3), 50, ["R1"]), "X", "Y")
    table = spark.range(50_000).selectExpr("concat('name-', id) as airline").union(
        spark.createDataFrame([("A",)], "airline string"))
    out = filter_airlines_table(rows, table)
    assert {r["Airline"] for r in out.collect()} == {"A"}
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
