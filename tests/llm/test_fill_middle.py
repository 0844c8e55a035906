"""Examples against a plain line splitter, rank and select against counting,
and the exact way back."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import by_id, docs, edge_rows, empty, random_rows
from pyspark.sql import functions as F

from farelens.llm import fill_middle as M


def plain(doc_id, text, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if doc_id is None:
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (lines[:lo], lines[lo:hi], lines[hi:]))
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows, **how):
    out = M.fill_in_middle(docs(spark, rows, clash=True), **how).withColumn("back", M.restore(F.col("output"), F.col("form")))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, got), key=key) == sorted(
        ((i, *plain(i, t, *how.values()), t or "") for i, t in rows), key=key)
    return out


def test_any_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        data[rng.random(n) < 0.3] = 10
        marks = M.Marks(M.equal_bytes(M.words_of(data), 10))
        places = np.flatnonzero(data == 10)
        every = np.arange(n + 1)
        assert (marks.rank(every) == np.searchsorted(places, every)).all()
        assert (marks.select(np.arange(1, len(places) + 1)) == places).all()
        more = M.Marks(M.continuing_bytes(M.words_of(data)))
        assert (more.rank(every) == np.concatenate([[0], np.cumsum(data >> 6 == 2)])).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aé€🎉\n\r\t", max_size=30), min_size=1, max_size=6), st.integers(0, 2 ** 32 - 1),
       st.integers(0, 2 ** 32 - 1))
def test_cuts_of_any_texts(texts, h1, h2):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(x) for x in raw])
    k = len(texts)
    n, one, two, prefix, middle = M._cut(np.frombuffer(b"".join(raw), np.uint8), bounds, np.full(k, h1), np.full(k, h2))
    for i, t in enumerate(texts):
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        lo, hi = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        a, b = "".join(lines[:lo]), "".join(lines[:hi])
        assert (n[i], prefix[i], middle[i]) == (len(lines), len(a), len(b) - len(a))
        assert (one[i] - bounds[i], two[i] - bounds[i]) == (len(a.encode()), len(b.encode()))


def test_documents(spark):
    marked = [(800, "a<P>b\nc"), (801, "x\n<"), (802, "P>\nS>\n<"), (803, "<M>"), (804, "\n" * 50), (805, "é\n🎉\r\n€"),
              (806, "<S\n>\n<"), (-5, "a\nb\nc\nd"), (2 ** 62, "a\nb\nc\nd")]
    rows = random_rows(1, 80) + edge_rows() + marked + [(900 + i, "1\n2\n3\n4\n<\n>5") for i in range(60)]
    out = check(spark, rows)
    assert {"plain", "psm", "spm"} == {r[0] for r in out.select("form").distinct().collect()}
    assert by_id(out)[804]["n"] == 50
    assert M.fill_in_middle(empty(spark)).count() == 0


def test_shares(spark):
    rows = [(i, "a\nb\nc") for i in range(200)]
    forms = [r[0] for r in check(spark, rows, fim_percent=60, spm_percent=100).select("form").collect()]
    assert "psm" not in forms and 0 < forms.count("plain") < 140
