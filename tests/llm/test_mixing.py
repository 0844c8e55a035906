"""Targets and quotas against plain arithmetic; what documents give."""

import heapq
import random
import re

import pytest
from llm_data import docs, edge_rows, empty, random_rows

from farelens.llm import mixing as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / w for s in open_}
        for s in above:
            out[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return out


def check(rows, out):
    size = {}
    for i, t in rows:
        if i is not None:
            s = None if i % 7 == 0 else f"s{i % 5}"
            size[s] = size.get(s, 0) + len(WORDS.findall(t or ""))
    want, taken = targets(size), {}
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in taken:
        assert abs(taken[s] - want[s]) <= 2 + 0.02 * want[s], s


def test_mix_reaches_targets_and_reruns_agree(spark):
    rows = random_rows(1, 300)
    df = docs(spark, rows, clash=True)
    out = M.mix_sources(df).collect()
    assert len(out) == len(rows)
    check(rows, out)
    again = M.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_WORDS", 2000)
    rows = random_rows(2, 300)
    check(rows, M.mix_sources(docs(spark, rows)).collect())


def test_edges(spark):
    out = M.mix_sources(docs(spark, edge_rows(), clash=True)).collect()
    check(edge_rows(), out)
    assert len(out) == len([i for i, _ in edge_rows() if i is not None])
    assert M.mix_sources(empty(spark)).count() == 0
    assert [r["taken"] for r in M.mix_sources(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


@pytest.mark.parametrize("seed,seats", [(1, 50), (2, 977), (3, 3), (4, 100_003)])
def test_apportionment_by_highest_quotients(spark, seed, seats):
    rng = random.Random(seed)
    votes = {f"c{i:02d}": rng.choice([rng.randint(1, 100_000), 5000]) for i in range(40)}
    queue = [(-v / 0.5, c, 0) for c, v in votes.items()]
    heapq.heapify(queue)
    want = dict.fromkeys(votes, 0)
    for _ in range(seats):
        _, c, k = heapq.heappop(queue)
        want[c] += 1
        heapq.heappush(queue, (-votes[c] / (k + 1.5), c, k + 1))
    cells = spark.createDataFrame([(c, float(v)) for c, v in votes.items()], "cell string, votes double")
    got = {r["cell"]: r["quota"] for r in M.apportion(cells, seats, ["cell"]).collect()}
    assert sum(got.values()) == seats and got == want
