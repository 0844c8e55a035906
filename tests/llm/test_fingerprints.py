"""Sketches against a plain one-permutation MinHash over exact sets."""

import hashlib
import re

import numpy as np
from llm_data import docs, edge_rows, empty, random_rows

from farelens.llm import fingerprints as P

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORDS.findall(t or "")
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(t, nxt):
    k = len(t) // 4
    return t[:len(t) - k] + nxt[:k]


def check_exact(rows, out):
    order = sorted({(i, t or "") for i, t in rows if i is not None})
    by = {r["doc_id"]: r for r in out}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        assert by[i]["n_chars"] == len(t)
        assert by[i]["edited_sha256"] == hashlib.sha256(edited(t, nxt).encode()).hexdigest()
        assert 0 <= by[i]["near_edited"] <= 1 and 0 <= by[i]["near_next"] <= 1
    same = {}
    for i, t in order:
        assert same.setdefault(t, by[i]["fingerprint"]) == by[i]["fingerprint"]
    return order, by


def test_edits_and_likeness(spark):
    rows = random_rows(5, 200)
    order, by = check_exact(rows, P.fingerprint_edits(docs(spark, rows, clash=True)).collect())
    errors = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        errors.append(by[i]["near_edited"] - jaccard(shingles(t), shingles(edited(t, nxt))))
        errors.append(by[i]["near_next"] - jaccard(shingles(t), shingles(nxt)))
    assert np.std(errors) < 0.04 and abs(np.mean(errors)) < 0.01
    assert len(set(by[i]["fingerprint"] for i, _ in order)) == len({t for _, t in order})


def test_edges(spark):
    out = P.fingerprint_edits(docs(spark, edge_rows(), clash=True)).collect()
    assert len(out) == len([i for i, _ in edge_rows() if i is not None])
    check_exact(edge_rows(), out)
    assert all(len(r["fingerprint"]) == P.BINS for r in out)
    assert P.fingerprint_edits(empty(spark)).count() == 0
    lone = P.fingerprint_edits(docs(spark, [(1, "abcdefgh")])).first()
    assert lone["near_next"] == 1 and lone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_plain_map_agrees(spark):
    rows = random_rows(6, 40)
    a = {r["doc_id"]: r["fingerprint"] for r in P.fingerprint_documents(docs(spark, rows)).collect()}
    b = {r["doc_id"]: r["fingerprint"] for r in P.fingerprint_edits(docs(spark, rows)).collect()}
    assert a == b
