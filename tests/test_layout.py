"""The route layout of a written table: files opened by a search, hot routes, odd values."""

import glob

from pyspark.sql import functions as F

from farelens import schema as S
from farelens.operators.search import route_rows, route_rows_sql, search_flights, search_summary
from farelens.sources import ingest_flights, load_flights, register_view
from farelens.sources.layout import bucket_column


def _table(spark, routes, rows_each):
    """``rows_each`` rows of each of ``routes`` routes; the first is C0 to D0."""
    n = F.floor(F.col("id") / rows_each).cast("string")
    return spark.range(routes * rows_each).select(
        F.lit("A").alias(S.AIRLINE), F.lit("2019-01-01").cast("date").alias(S.DATE),
        F.concat(F.lit("C"), n).alias(S.SOURCE), F.concat(F.lit("D"), n).alias(S.DESTINATION),
        F.concat(F.lit("C"), n, F.lit("-D"), n).alias(S.ROUTE), F.lit("10:00:00").alias(S.DEP_TIME),
        F.lit("12:00:00").alias(S.ARRIVAL_TIME), F.lit("2h").alias(S.DURATION), F.lit("non-stop").alias(S.STOPS),
        (F.col("id") % rows_each).cast("int").alias(S.PRICE))


def _files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_files_read_for_a_route_do_not_grow_with_the_table(spark, tmp_path):
    read, there = [], []
    for k, (routes, buckets) in enumerate([(100, 4), (400, 16), (1600, 64)]):
        path = str(tmp_path / f"t{k}")
        stored = ingest_flights(_table(spark, routes, 20), path, partitions=buckets)
        there.append(len(glob.glob(f"{path}/*/*.parquet")))
        rows = route_rows(stored, "C0", "D0")
        assert sorted(r["Price"] for r in rows.collect()) == list(range(20))
        read.append(_files_read(route_rows(stored, "C0", "D0")))
        register_view(stored, "laid_out")
        by_text = route_rows_sql(spark, "C0", "D0", "laid_out")
        assert by_text.count() == 20 and _files_read(route_rows_sql(spark, "C0", "D0", "laid_out")) == read[-1]
        assert _files_read(route_rows(load_flights(spark, path), "C0", "D0")) == read[-1]
    assert there[0] < there[1] < there[2]
    assert read == [1, 1, 1], (read, there)


def test_a_hot_route_is_dealt_out_over_files(spark, tmp_path):
    # text that doesn't compress, so that the route's shuffle part has some size
    noise = F.sha2(F.col(S.PRICE).cast("string"), 512)
    hot = _table(spark, 1, 60_000).withColumn(S.AIRLINE, noise)
    rest = _table(spark, 1000, 60).where(f"{S.SOURCE} <> 'C0'").withColumn(S.AIRLINE, noise)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        stored = ingest_flights(hot.union(rest).repartition(8), str(tmp_path / "t"), partitions=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert stored.count() == 60_000 + 999 * 60
    per_file = (stored.where(F.col(S.SOURCE) == "C0").groupBy(F.input_file_name().alias("f")).count()
                .select("count").collect())
    assert len(per_file) > 2 and max(r[0] for r in per_file) < 40_000
    found = search_summary(stored, "C0", "D0").collect()[0]
    assert found["flights_found"] == 60_000 and found["cheapest_price"] == 0


def test_searches_equal_those_of_a_table_without_buckets(spark, tmp_path):
    plain = _table(spark, 30, 5)
    odd = plain.limit(4).withColumn(S.SOURCE, F.lit(None).cast("string"))
    odd = odd.union(plain.limit(3).withColumn(S.DESTINATION, F.lit(""))).union(plain.limit(2).withColumn(S.SOURCE, F.lit("c0")))
    plain = plain.union(odd)
    stored = ingest_flights(plain, str(tmp_path / "t"), partitions=7)
    assert bucket_column(stored.columns) == ("route_bucket_7", 7) and bucket_column(plain.columns) is None
    assert stored.count() == plain.count()
    for pair in [("C0", "D0"), ("c0", "D0"), ("C0", ""), ("C0", "D1"), ("", ""), ("é", "x'y")]:
        for fold in (False, True):
            a = search_flights(stored, *pair, ignore_case=fold).collect()
            assert a == search_flights(plain, *pair, ignore_case=fold).collect(), (pair, fold)
    # an ingested table that is ingested again gets new buckets
    again = ingest_flights(stored, str(tmp_path / "u"), partitions=3)
    assert bucket_column(again.columns) == ("route_bucket_3", 3) and again.count() == plain.count()
    empty = ingest_flights(plain.limit(0), str(tmp_path / "e"), partitions=3)
    assert empty.count() == 0


def test_texts_are_made_behind_the_shuffle(spark, tmp_path, monkeypatch):
    """What can be computed from a row is neither dealt out nor sorted with it."""
    from farelens.sources import flights as fl
    narrow = [S.AIRLINE, S.DATE, S.SOURCE, S.DESTINATION, S.PRICE]
    full = _table(spark, 6, 5)

    def derive(rows):
        made = {c: F.lit(full.first()[c]) for c in (S.DEP_TIME, S.ARRIVAL_TIME, S.DURATION, S.STOPS)}
        made[S.ROUTE] = F.concat(S.SOURCE, F.lit("-"), S.DESTINATION)
        return rows.select(*[made[c].alias(c) if c in made else c for c in full.columns], bucket_column(rows.columns)[0])
    parsed = []
    monkeypatch.setattr(fl, "with_parsed", lambda rows, f=fl.with_parsed: parsed.append(rows) or f(rows))
    late = ingest_flights(full.select(narrow), str(tmp_path / "a"), partitions=4, derive=derive)
    early = ingest_flights(full, str(tmp_path / "b"), partitions=4)
    assert late.columns == early.columns and late.schema == early.schema
    assert sorted(late.collect(), key=str) == sorted(early.collect(), key=str)
    for rows in parsed:
        assert "RebalancePartitions" in rows._jdf.queryExecution().analyzed().toString()
    assert len(parsed) == 2
