"""The pipeline's stages keep their contract, and the registered queries exist."""

import os

import pytest
from llm_data import docs, random_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_entry_lists_the_queries():
    from __spark_entry__ import queries
    names = list(queries())
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == \
        [n for n in names if n.startswith("op")] and len([n for n in names if n.startswith("op")]) == 13 + names.count("op")
    assert "pipeline" in names


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_stages_on_data(spark):
    from farelens.llm.common import stage_table
    table = spark.read.parquet(f"{SF}/documents.parquet")
    ids, bench = {r["doc_id"] for r in table.collect()}, spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    frame, labels = table, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in frame.collect()}
        frame = stage_table(spark, stage(spark, frame, SF), "t")
        now = frame.collect()
        kept = [r["doc_id"] for r in now]
        assert len(kept) == len(set(kept)) and set(kept) <= before <= ids, name
        if name != "source_mix":
            assert frame.columns == table.columns, name
        if name == "quality":
            assert sum(labels.get(i) == 0 for i in kept) <= 0.1 * sum(q == 0 for q in labels.values())
            assert sum(labels.get(i) == 1 for i in kept) >= 0.95 * sum(q == 1 for q in labels.values())
        if name == "decontamination":
            assert not any(b["text"] in r["text"] for r in now for b in bench if len(b["text"]) > 60)
    assert all(r["taken"] > 0 and r["taken"] <= 2 * r["size"] for r in now)


def test_repeated_ids_leave_one_row(spark):
    rows = random_rows(3, 30)
    df = docs(spark, rows + rows[:5])
    out = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert len(out) == len({r["doc_id"] for r in out})


def test_columns_of_the_mix_in_the_documents(spark):
    import corpus_pipeline as P
    from llm_data import docs
    rows = [(i, "some words " * (i + 1)) for i in range(8)]
    got = P.source_mix(spark, docs(spark, rows, clash=True), "")
    assert got.columns == [*P.COLUMNS, "size", "source_size", "target", "taken"] and got.count() > 0


def test_rows_that_repeat_an_id(spark):
    import corpus_pipeline as P
    from llm_data import docs
    rows = [(1, "b"), (1, "a"), (1, "c"), (2, "x"), (3, None), (3, "y"), (None, "n"), (None, "n")]
    got = sorted(((r["doc_id"], r["text"]) for r in P.one_row_per_id(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "a"), (2, "x"), (3, None), (None, "n"), (None, "n")], key=str)
