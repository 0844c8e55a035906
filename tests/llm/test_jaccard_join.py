"""Components against all pairs."""

import re

import pytest
from llm_data import docs, edge_rows, empty, lowered, random_rows

from farelens.llm.jaccard_join import jaccard_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lowered(t))
        if i is not None:
            sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows if i is not None)


def got(df, **k):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, **k).collect())


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_random_texts(spark, seed, width, percent):
    rows = random_rows(seed, 200)
    assert got(docs(spark, rows), width=width, percent=percent) == plain(rows, width, percent)


def test_chains_of_near_copies(spark):
    """Each text differs from the next a little, the ends of the chain a lot."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        w = list(words)
        for j in range(k):
            w[(7 * j) % 120] = f"n{j}"
        rows.append((500 - k, " ".join(w)))
    assert got(docs(spark, rows), width=3, percent=90) == plain(rows, 3, 90)


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (2, a + " x"), (3, b + " y"), (4, "c d e f")]
    out = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(docs(spark, rows), width=3, percent=90).collect())
    assert out == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_edges(spark):
    assert got(docs(spark, edge_rows(), clash=True), width=3, percent=90) == plain(edge_rows(), 3, 90)
    assert jaccard_components(empty(spark)).count() == 0


def test_passages_that_many_documents_share(spark, monkeypatch):
    """Open groups get new orders, in parts, and lose no link."""
    import random

    from farelens.llm import jaccard_join as J
    rng = random.Random(8)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(4)]
    rows = []
    for i in range(160):
        own = " ".join(f"d{i}x{rng.randrange(10 ** 6)}" for _ in range(rng.randint(20, 60)))
        rows.append((i, f"{own} {passages[i % 4]}" if i % 3 else f"{passages[i % 4]} {own}"))
    for i in range(60):
        words = rows[rng.randrange(160)][1].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((1000 + i, " ".join(words)))
    want = {p: plain(rows, 3, p) for p in (60, 90)}
    asked = []
    for pairs, part in ((0, 3), (10 ** 6, 512)):
        monkeypatch.setattr(J, "PAIRS", pairs)
        monkeypatch.setattr(J, "PART", part)
        monkeypatch.setattr(J, "_open_rows", lambda *a, f=J._open_rows: asked.append(pairs) or f(*a))
        for percent in want:
            assert got(docs(spark, rows), width=3, percent=percent) == want[percent]
    assert asked.count(0) > 4


@pytest.mark.parametrize("percent", [75, 80, 90, 97])
def test_least_similar_sets_share_neighbours(percent):
    """Sets as different as they may be, with the differences in the first gaps of
    the order: the prefixes still hold common neighbours at allowed places."""
    from farelens.llm import jaccard_join as J
    for n in range(2, 150):
        for m in range(n, 2 * n):
            common = -(-percent * (n + m) // (100 + percent))
            if common > n or n == m == common:
                continue
            extra = [0] * (n - common) + [1] * (m - common)
            for order in (extra, extra[::-1], [x for k in range(len(extra)) for x in extra[k::len(extra) // 2 + 1]][:len(extra)]):
                a, b, k = [], [], 0
                for c in range(common):
                    a.append(c)
                    b.append(c)
                    if k < len(order):
                        (b if order[k] else a).append(("own", k))
                        k += 1
                at = {x: i for i, x in enumerate(zip(b, b[1:]))}
                assert any(p in at and i < J._starts(len(a), percent) and at[p] < J._starts(len(b), percent)
                           and (100 + percent) * (i + at[p]) <= 3 * (100 - percent) * (len(a) + len(b))
                           for i, p in enumerate(zip(a, a[1:]))), (n, m)


@pytest.mark.parametrize("percent", [75, 90])
def test_pairs_at_the_threshold(spark, percent):
    """Pairs of texts of own words just at, above and below the similarity."""
    import random
    rng = random.Random(percent)
    rows = []
    for i in range(150):
        n = rng.randint(3, 120)
        words = [f"v{i}x{k}" for k in range(n)]
        union = 100 * n // percent + rng.choice((-1, 0, 0, 1))
        put = max(0, union - n)
        other = words + [f"u{i}x{k}" for k in range(put)]
        drop = rng.randint(0, put)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other[drop // 2:]))]
    assert got(docs(spark, rows), width=1, percent=percent) == plain(rows, 1, percent)


def test_pairs_that_differ_too_much_do_not_leave_the_join(spark, monkeypatch):
    """Texts that share most words, and so many groups, but not enough of them: the
    bounds drop their pairs before any set is compared."""
    import random

    from farelens.llm import jaccard_join as J
    rng = random.Random(5)
    words = [f"c{k}" for k in range(300)]
    rows = []
    for i in range(40):
        own = set(rng.sample(range(300), 30))
        rows.append((i, " ".join(f"o{i}x{k}" if k in own else w for k, w in enumerate(words))))
    near = []
    stage = J.stage_table

    def staged(session, df, name):
        out = stage(session, df, name)
        if name == "near":
            near.append(out.count())
        return out
    monkeypatch.setattr(J, "stage_table", staged)
    assert got(docs(spark, rows), width=1, percent=90) == plain(rows, 1, 90) == [(i, 300, i) for i in range(40)]
    assert near == [0]


def test_parities_never_exceed_the_difference():
    import numpy as np

    from farelens.llm import jaccard_join as J
    rng = np.random.default_rng(3)
    for n, d in [(1, 0), (5, 3), (300, 40), (300, 200), (20_000, 3_000)]:
        both = rng.integers(0, 1 << 63, n + d, dtype=np.uint64)
        a, b = J._parities(both[:n]), J._parities(both[d:])
        apart = int(np.unpackbits((a ^ b).view(np.uint8)).sum())
        assert apart <= 2 * min(d, n) + abs(n - len(both[d:]))
        assert (apart == 0) == (d == 0)


def runs_of(rows, percent, order=0):
    """Groups of each text of words, in one batch."""
    import numpy as np
    import pyarrow as pa

    from farelens.llm import jaccard_join as J
    none = np.zeros(0, np.uint64)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(r) for r in rows])})
    group, fp, _, _ = J._grouped_runs(batch, 1, percent, none, none, order)
    out = {}
    for g, f in zip(group.tolist(), fp.tolist()):
        out.setdefault(f, set()).add(g)
    return list(out.values())


@pytest.mark.parametrize("percent", [60, 75, 80, 90, 97])
def test_sets_that_link_share_a_run(percent):
    """Sets just at the similarity, of equal sizes and as different in size as they may be."""
    import random
    rng = random.Random(percent)
    least = -(-percent // (100 - percent))
    for n in [*range(least, least + 40), 150, 400, 1500]:
        for m in {n, n + 1, 100 * n // percent, (n + 100 * n // percent) // 2}:
            common = -(-percent * (n + m) // (100 + percent))
            if common > n or n == m == common:
                continue
            for k in range(6 if n < 100 else 2):
                both = [f"c{n}x{m}x{k}x{rng.random()}x{i}" for i in range(common)]
                a, b = (both + [f"{side}{i}x{rng.random()}" for i in range(size - common)] for side, size in (("a", n), ("b", m)))
                one, two = runs_of([a, b], percent, k % 3)
                assert one & two, (n, m)


def test_prefixes_have_about_a_run_per_difference():
    """What the group step shuffles: neighbours within twice the prefix were 0.3 groups a
    token at 90 and 0.6 at 80."""
    import random
    rng = random.Random(4)
    rows = [[f"t{i}x{k}" for k in range(rng.randint(60, 600))] for i in range(300)]
    tokens = sum(map(len, rows))
    for percent, most in ((90, 0.17), (80, 0.40)):
        assert sum(map(len, runs_of(rows, percent))) < most * tokens


def test_sets_with_fewer_runs_than_differences_meet(monkeypatch):
    from farelens.llm import jaccard_join as J
    monkeypatch.setattr(J, "_cuts", lambda top, percent: 1)
    words = [f"w{i}" for i in range(60)]
    one, two = runs_of([words, words[1:] + ["x"]], 80)
    assert one & two


def test_few_other_groups_pass_the_bitmap(spark, monkeypatch):
    import numpy as np

    from farelens.llm import jaccard_join as J
    monkeypatch.setattr(J, "GROUP_BITS", 1 << 16)
    groups = np.random.default_rng(1).integers(0, 1 << 64, 60_000, dtype=np.uint64)
    held, other = groups[:4_000], groups[4_000:]
    sketch = J._group_sketch(spark.createDataFrame([(int(g),) for g in held.view(np.int64)], "grp long"))
    assert J._in_groups(sketch, held).all()
    assert J._in_groups(sketch, other).mean() < 0.03  # one place each: 0.06


def test_one_table_of_powers_serves_all_blocks():
    """A worker keeps it: one of 32 MB and smaller ones before."""
    import numpy as np

    from farelens.llm import common as C
    C._powers.cache_clear()
    for n in (10, 70_000, C.BLOCK_BYTES):
        C.Rolling(np.zeros(n, np.uint8))
    assert C._powers.cache_info().currsize == 1
    assert sum(x.nbytes for x in C.powers(C.BLOCK_BYTES + 1)) <= 16 * (C.BLOCK_BYTES + 1) <= 17 << 20


def test_pairs_leave_the_join_in_their_first_group(spark, monkeypatch):
    """Texts that are almost alike enough share very many groups: a pair is one row."""
    import random

    from farelens.llm import jaccard_join as J
    rng = random.Random(6)
    rows = []
    for i in range(30):
        own = set(rng.sample(range(400), 24))
        rows.append((i, " ".join(f"o{i}x{k}" if k in own else f"c{k}" for k in range(400))))
    made = []

    def pairs(left, *how, f=J._pairs_in_groups):
        out = f(left, *how)
        met = (left.alias("x").join(left.alias("y"), "grp").where("x.fp < y.fp and x.label <> y.label"))
        made.append((out.count(), out.distinct().count(), met.count()))
        return out
    monkeypatch.setattr(J, "_pairs_in_groups", pairs)
    assert got(docs(spark, rows), width=1, percent=80) == plain(rows, 1, 80)
    (rows_made, distinct, met), = made
    assert distinct > 100 and met > 10 * distinct and rows_made <= 1.1 * distinct


def test_long_texts_that_differ_too_much_do_not_leave_the_join(spark, monkeypatch):
    """1024 parities of sets of 3000 tokens never differ in more than sets that link may."""
    import random

    from farelens.llm import jaccard_join as J
    rng = random.Random(7)
    rows = []
    for i in range(20):
        own = set(rng.sample(range(3000), 900))
        rows.append((i, " ".join(f"o{i}x{k}" if k in own else f"c{k}" for k in range(3000))))
    rows.append((50, rows[3][1] + " and a little more"))
    near = []
    stage = J.stage_table

    def staged(session, df, name):
        out = stage(session, df, name)
        if name == "near":
            near.append(out.count())
        return out
    monkeypatch.setattr(J, "stage_table", staged)
    assert got(docs(spark, rows), width=1, percent=80) == plain(rows, 1, 80)
    assert near == [0]
