"""Marginals against all labelings; held-out accuracy on planted junk."""

import itertools
import random
import zlib

import numpy as np
import pytest
from llm_data import docs, edge_rows, empty, random_rows

from farelens.llm import quality as Q


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    chain = Q.Chain(rng.normal(size=4), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(4), np.ones(4))
    x = rng.normal(size=(9, 4))
    first = np.array([0, 5, 6, 9])
    good, joint = chain.marginals(x, first, pairs=True)
    want, want_joint = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        total, ones, steps = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product([0, 1], repeat=int(b - a)):
            s = chain.s[y[0]] + sum(x[a + k] @ chain.w * y[k] for k in range(b - a)) \
                + sum(chain.t[y[k], y[k + 1]] for k in range(b - a - 1))
            p = np.exp(s)
            total += p
            ones += p * np.array(y)
            for k in range(b - a - 1):
                steps[y[k], y[k + 1]] += p
        want[a:b] = ones / total
        want_joint += steps / total
    assert np.allclose(good, want) and np.allclose(joint, want_joint)


def labelled(spark, seed=3):
    rng = random.Random(seed)
    rows = random_rows(seed, 400, 1000)
    labels = []
    for k, (i, t) in enumerate(rows):
        bad = rng.random() < 0.2
        if bad:
            t = rng.choice([lambda t: " ".join(w + rng.choice(["***", "###"]) for w in t.split(" ")),
                            lambda t: " ".join(w for w in t.split(" ")[:20] for _ in range(6)),
                            lambda t: t.upper().replace(" ", "!! ")])(t)
        rows[k] = (i, t)
        labels.append((i, int(not bad), 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels}


def test_held_out_accuracy(spark):
    rows, labels, truth = labelled(spark)
    out = Q.score_quality(docs(spark, rows, clash=True), labels).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_filter_keeps_what_is_predicted_good(spark):
    rows, labels, _ = labelled(spark)
    df = docs(spark, rows)
    kept = Q.keep_good(df, labels)
    assert kept.schema == df.schema
    want = {r["doc_id"] for r in Q.score_quality(df, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_edges(spark):
    rows, labels, _ = labelled(spark)
    odd = labels.union(spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 0, 0), (2, 1, 0)], labels.schema))
    out = Q.score_quality(docs(spark, edge_rows() + rows, clash=True), odd).collect()
    assert len(out) == len(rows) + len([i for i, _ in edge_rows() if i is not None])
    assert Q.score_quality(empty(spark), labels).count() == 0
    none = labels.where("doc_id is null")
    assert [r["score"] for r in Q.score_quality(docs(spark, rows[:5]), none).collect()] == pytest.approx([0.5] * 5)


def test_fit_reads_all_lines_of_a_document(spark, monkeypatch):
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5 != 0][:4]
    rows = [(i, "\n".join(f"line {k} of it" if k < 60 else "*** ### ***" for k in range(n)))
            for i, n in zip(ids, (1, 48, 49, 405))]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, first, label: seen.append((x, first)))
    Q.train(docs(spark, rows), labels)
    x, first = seen[0]
    assert sorted(np.diff(first)) == [1, 48, 49, 405] and len(x) == 503
    assert (x[:, 0] > 0.5).sum() == 345   # the lines of symbols, all far down
