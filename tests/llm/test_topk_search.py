"""Every query's list against all integer inner products."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from farelens.llm import topk_search as S

SCHEMA = "vec_id long, embedding array<float>, pos string, id string, vec string, pivot string, n string"


def brute(rows, k, scale=64, every=5):
    own = []
    for n, (i, v) in enumerate(rows):
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((n, i, [math.floor(float(x) * scale) for x in v]))
    out = []
    for n, i, q in own:
        if i % every == 0:
            found = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(q, v)))), j) for m, j, v in own if m != n)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def check(spark, rows, k=20, sizes=None):
    sizes = sizes or SMALL
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)
    out = S.exact_top_k(df, F.col("id") % 5 == 0, k, sizes=sizes)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows, k)
    return got


SMALL = S.Sizes(sample=40, pivots=6, block=16, queries=8, ring=4, piece=3, together=2)


def test_random_clustered_and_common_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    rows = [(int(i), (centres[i % 5] + 0.05 * rng.normal(size=8)).tolist()) for i in rng.permutation(120)]
    rows += [(200 + i, [0.5] * 8) for i in range(40)]           # one common vector, so ties by vec_id
    rows += [(300 + i, (3 * rng.normal(size=8)).tolist()) for i in range(10)]
    check(spark, rows, 7)


def test_nulls_sizes_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (5, [None, 1.0]), (10, [nan, 1.0]), (15, [inf, 1.0]), (None, [1.0, 1.0]), (20, []), (25, [1.0]),
            (30, [1.0, -2.0, 3.0]), (30, [1.0, -2.0, 3.0]), (30, [-1.0, 0.01, 0.0]), (31, [0.0, 0.0]), (35, [-0.01, 5.0]), (-5, [2.0])]
    got = check(spark, rows)
    assert sum(q == 30 for q, *_ in got) == 3 * 7
    check(spark, rows, 2)


def test_scores_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 37) for _ in range(3)]) for i in range(20)]
    got = check(spark, rows, 4)
    assert any(s == 2 ** 63 - 1 for *_, s in got)
    check(spark, [(i, [i * 2.0 ** 24, 1.0]) for i in range(20)], 4)


def test_few_rows_and_none(spark):
    assert check(spark, [], sizes=S.Sizes()) == []
    assert check(spark, [(5, [1.0])], sizes=S.Sizes()) == []
    assert check(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert check(spark, [(5, [1.0]), (1, [0.5])]) == [(5, 1, 1, 64 * 32)]


def test_bounds_hold_and_cut(monkeypatch):
    """No score is above its annulus' bound, and far annuli are not scored."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 6)) * 20
    x = np.floor(64 * (centres[np.arange(800) % 8] + 0.1 * rng.normal(size=(800, 6))))
    top = (x * x).sum(1).max()
    last = S._last(x, top)
    pivots = S.fit_pivots(x[:200], last[:200], 8)
    dist = S._distances(x, last, pivots)
    own = dist.argmin(1)
    order = np.lexsort((dist[np.arange(800), own], own))
    block = {"row": order, "id": order, "pivot": own[order], "dist": dist[np.arange(800), own][order], "vec": x[order]}
    at = np.arange(0, 800, 40)
    queries = {"row": at, "id": at, "vec": x[at]}
    single = S.upper_bounds(S._distances(x[at], np.zeros(20), pivots), (x[at] ** 2).sum(1), top, block["pivot"], block["dist"], block["dist"])
    assert (x[at] @ x[order].T <= single).all()
    seen = []
    plain = S.scores
    monkeypatch.setattr(S, "scores", lambda q, v: seen.append(len(q) * len(v)) or plain(q, v))
    floor = np.sort(x[at] @ x.T, axis=1)[:, -6]
    search = S.Search(5, queries, pivots, top, floor.astype(float), 25)
    for lo in range(0, 800, 200):
        search.meet({c: x[lo:lo + 200] for c, x in block.items()})
    assert sum(seen) < 0.6 * 20 * 800
    got = pa.Table.from_batches([search.rows(0)]).to_pylist()
    for n, i in enumerate(at):
        want = sorted((-(x[i] @ x[j]), j) for j in range(800) if j != i)[:5]
        assert [(-r["score"], r["vec_id"]) for r in got if r["place"] == n] == want
