"""Greedy string tiling against a plain statement of it, and planted items."""

import random
import re

import numpy as np
import pytest
from llm_data import by_id, docs, edge_rows, empty, lowered

from farelens.llm import decontamination as D

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_tiles(a, b, least):
    """Longest common free stretch first; ties by place in b, then a."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < least:
            return out
        out.append((i, j, n))
        free_a[i:i + n] = [False] * n
        free_b[j:j + n] = [False] * n


@pytest.mark.parametrize("seed", range(30))
def test_tiles_are_the_plain_ones(seed):
    rng = random.Random(seed)
    a = [rng.randrange(6) for _ in range(rng.randint(0, 60))]
    b = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
    got = D.greedy_tiles([np.array(a, np.uint64)], np.array(b, np.uint64), 3)
    assert [(p, i, n) for _, p, i, n in got] == plain_tiles(a, b, 3)


def test_planted_items_are_caught(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(20)]
    clean = [(i, " ".join(rng.choices(vocab, k=200))) for i in range(100)]
    rows, want = list(clean), {}
    for k, (item, text) in enumerate(items):
        words = text.upper().split(" ")
        pre, post = rng.choices(vocab, k=50), rng.choices(vocab, k=50)
        whole = [*pre, *words, *post]
        swapped = [*pre, *words[15:], *post, *words[:15]]           # the halves change places
        fifth = [*pre, *words[:6], *post]                            # too little of it
        for j, (doc, hit) in enumerate(((whole, 1.0), (swapped, 1.0), (fifth, 0.2))):
            rows.append((1000 + 3 * k + j, " ".join(doc)))
            want[1000 + 3 * k + j] = (hit, item)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(D.contamination(docs(spark, rows, clash=True), bench))
    assert len(got) == len(rows)
    for i, (hit, item) in want.items():
        assert got[i]["coverage"] == pytest.approx(hit) and got[i]["item_id"] == item, i
        assert got[i]["contaminated"] == (hit >= 0.5)
    assert not any(got[i]["contaminated"] for i, _ in clean)


def test_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a b c d e f"),
                                   (4, "same words here again and again")], "item_id long, text string")
    out = D.contamination(docs(spark, edge_rows(), clash=True), bench).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in edge_rows() if i is not None)
    assert {r["doc_id"] for r in out if r["contaminated"]} == {7, 8}
    assert {r["doc_id"]: r["n_words"] for r in out}[1] == 0
    words = {i: len(WORDS.findall(lowered(t))) for i, t in edge_rows()}
    assert all(r["n_words"] == words[r["doc_id"]] for r in out)
    assert D.contamination(empty(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in D.contamination(docs(spark, edge_rows()), none).collect())


def test_an_item_without_an_id(spark):
    from llm_data import docs

    from farelens.llm.decontamination import contamination
    text = "seven words that stand in this item"
    items = spark.createDataFrame([(None, text), (5, "other words which are in no document at all")], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(docs(spark, [(1, text), (2, "clean words " * 9)]), items).collect()}
    assert got[1]["contaminated"] and got[1]["coverage"] == 1 and got[1]["item_id"] is None and got[1]["n_items"] == 1
    assert not got[2]["contaminated"]
