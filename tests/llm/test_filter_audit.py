"""Every order of the filters, applied one row after the other."""

import random
import re
from collections import defaultdict
from itertools import permutations

from llm_data import docs, edge_rows, empty, random_rows

from farelens.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, part string, mask string, n string"


def failed(text, copy):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return set(out + "E" * copy)


def brute(rows, labels):
    """rows: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    every = [(i, failed(t or "", i is not None and first[t or ""] < i), p or "") for i, t, p in rows]
    out, shapley = {}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, _, p in every}:
            alive = [(i, f) for i, f, p in every if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in alive if x in f]
                out[part, order, step] = [
                    len(alive) - len(removed), len(removed), sum(x in f for _, f in gone),
                    sum(f == {x} for _, f, p in every if p == part),
                    sum(i in good for i, _ in removed if i is not None), sum(i in toxic for i, _ in removed if i is not None)]
                shapley[part, x] += len(removed)
                alive, gone = [r for r in alive if x not in r[1]], gone + removed
    return {(p, o, s): (*x, shapley[p, o[s - 1]]) for (p, o, s), x in out.items()}


def audit(spark, rows, labels, clash=True):
    df = docs(spark, rows, clash=clash)
    parts = [(i, t, p["source"]) for (i, t), p in zip(rows, df.select("source").collect())]
    out = A.filter_interactions(df, spark.createDataFrame([(*r, "x", "y", "z") for r in labels], LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*A.COUNTS, "shapley")) for r in out}
    assert len(got) == len(out)
    assert got == brute(parts, labels)
    return got


def test_every_order(spark):
    rng = random.Random(3)
    rows = edge_rows()
    for i, t in random_rows(5, 150):
        if rng.random() < 0.3:
            t = t.upper() if rng.random() < 0.5 else t + " #" + " new words" * 150
        if rng.random() < 0.2:
            t = " ".join(f"{w}{k}" for k, w in enumerate((t.split() * 40)[:250]))
        rows.append((i, t))
    rows += [(5000 + k, rng.choice(rows)[1]) for k in range(60)] + [(5000, rows[20][1])]
    rows += [(1, rows[16][1]), (None, rows[16][1])]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i, _ in rows if i is not None and rng.random() < 0.6]
    got = audit(spark, rows, labels + [(None, 1, 1), (7, 1, None), (7, None, 1)])
    assert any(x[2] for x in got.values()) and any(x[3] for x in got.values())
    assert all(len({o for p, o, _ in got if p == part}) == 120 for part, _, _ in got)


def test_copies_are_judged_over_the_whole_table(spark):
    # sources differ: ids 1, 2 and 8 are of s1, s2 and s3; the first of the text stays
    got = audit(spark, [(8, "x y"), (2, "x y"), (1, "x y"), (1, "x y")], [])
    assert got["s1", "EABCD", 1][:2] == (2, 0) and got["s2", "EABCD", 1][:2] == (0, 1) and got["s3", "EABCD", 1][:2] == (0, 1)


def test_empty_tables(spark):
    no_labels = spark.createDataFrame([], LABELS)
    assert A.filter_interactions(empty(spark), no_labels).count() == 0
    assert A.filter_interactions(docs(spark, [(1, "a"), (None, None)]), no_labels).count() == 2 * 600
