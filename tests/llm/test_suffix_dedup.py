"""Removed bytes against a scan that remembers every 100-byte string."""

import hashlib
import random

import pytest
from llm_data import docs, edge_rows, empty, random_rows
from pyspark.sql import functions as F

from farelens.llm import suffix_dedup as S


def plain(rows):
    """(doc_id, text) in order -> removed flags of each distinct document."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - S.LENGTH + 1):
            w = raw[p:p + S.LENGTH]
            if w in seen:
                gone[p:p + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(w)
        out[i, t] = gone
    return out


def check(spark, rows, clash=False):
    got = sorted(tuple(r) for r in S.remove_repeats(docs(spark, rows, clash)).select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long"), "n_removed", "n_spans",
        F.sha2("kept", 256)).collect())
    flags = plain(rows)
    want = []
    for i, t in rows:
        if i is None:
            continue
        raw, gone = (t or "").encode(), flags[i, t or ""]
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    check(spark, random_rows(seed))


def test_periodic_and_boundary_texts(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = [(1, "ab" * 200), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, base), (6, base[:100]), (7, base[1:101] + "c"),
            (8, base[:150] + "X" + base[150:]), (9, "abc" * 100), (10, "é" * 60), (11, "x" + "é" * 60),
            (12, base[50:149]), (13, base[50:149] + "Z" + base[200:300]), (14, ("ab" * 60 + "\n") * 5)]
    check(spark, rows)


def test_edges(spark):
    rows = [r for r in edge_rows() if r[0] not in (10, 11)] + [(10, "long " * 4000), (11, "long " * 4000)]
    check(spark, rows, clash=True)
    assert S.remove_repeats(empty(spark)).count() == 0


def test_one_id_with_several_texts(spark):
    """Such rows are ordered by text hash: one of the two equal halves goes."""
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(300))
    out = S.remove_repeats(docs(spark, [(1, a + "x"), (1, a + "y")])).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 300]


def test_cut_keeps_columns(spark):
    rows = random_rows(4, 60)
    df = docs(spark, rows)
    out = S.cut_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    flags = plain(rows)
    for r in out.collect():
        text = dict(rows)[r["doc_id"]]
        kept = bytes(c for c, g in zip(text.encode(), flags[r["doc_id"], text]) if not g)
        assert r["text"] == kept.decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])
