"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are ratios counted on its bytes
and words (symbols, capitals, digits, table bars, repeated words, copies of the
line in its document, ...), and the same of the lines before and after. The
chain's transition weights make neighbouring lines agree. Labelled documents
give their label to each of their lines; weights are fitted by gradient on the
conditional likelihood, with forward-backward sums. A document's score is the
mean of its lines' marginal probabilities of "good", weighted by length.

The fit uses at most ``train_docs`` labelled documents, those of the smallest
seeded hash, with all their lines; scoring reads every line of every document. Text is the only input of a score.

Defined results: a null or empty text is one empty line; lines are cut at
"\\n"; several labels of one document count by their mean; repeated rows are
scored each; without labels of both kinds every line is scored 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import Block, Rolling, Words, arrow_map, blocks, longs, mix, pieces, texts

TRAIN_DOCS = 6000
THRESHOLD = 0.3
SEED = 11


def _marks(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


# Byte classes counted in a line.
CLASSES = np.stack([
    _marks("*#%&$@^~=+<>{}[]\\_"),
    _marks("|"),
    _marks("!?"),
    _marks(".,;:"),
    _marks("0123456789"),
    _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    np.arange(256) >= 0x80,
]).astype(np.float32)
N_BASE = len(CLASSES) + 7


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [lines, N_BASE], length in bytes, first line of each text)."""
    data, bounds = block.data, block.bounds
    breaks = np.flatnonzero(data == 10)
    n_docs = len(bounds) - 1
    # a line starts at each text's start and behind each break
    starts = np.concatenate([bounds[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(bounds, breaks, "right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = bounds[1:]
    length = ends - starts
    size = np.maximum(length, 1).astype(np.float32)

    cols = []
    for marks in CLASSES:
        sums = np.concatenate([[0], np.cumsum(marks[data], dtype=np.float64)])
        cols.append(((sums[ends] - sums[starts]) / size).astype(np.float32))
    words = Words(block)
    w0, w1 = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
    n_words = np.maximum(w1 - w0, 1).astype(np.float32)
    again = np.zeros(len(words.hash) + 1, np.float64)
    if len(words.hash) > 1:
        same = np.zeros(len(words.hash), np.float64)
        same[1:] = words.hash[1:] == words.hash[:-1]
        np.cumsum(same, out=again[1:])
    inner = np.minimum(w0 + 1, np.maximum(w1, w0))
    cols.append(((again[w1] - again[inner]) / n_words).astype(np.float32))
    content = words.rolling.of(starts, ends)
    keyed = mix(content + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(keyed, return_inverse=True, return_counts=True)
    repeated = (count[back] > 1) & (w1 > w0)
    cols.append(repeated.astype(np.float32))
    cols.append(np.minimum(size / n_words, 30).astype(np.float32) / 10)
    cols.append((w1 - w0 <= 1).astype(np.float32))
    cols.append((length == 0).astype(np.float32))
    cols.append(np.log1p(length).astype(np.float32) / 8)
    ends_well = np.zeros(len(starts), np.float32)
    full = length > 0
    ends_well[full] = np.isin(data[ends[full] - 1], [ord(c) for c in ".!?"])
    cols.append(ends_well)
    return np.stack(cols, axis=1), length, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the lines before and after (zeros
    beyond the text's ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), np.float32)], axis=1)


class Chain:
    """Weights of the field: ``w`` scores good against bad, ``t[a, b]`` the step
    from state a to b, ``s`` the start state."""

    def __init__(self, w: np.ndarray, t: np.ndarray, s: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w, self.t, self.s, self.mean, self.scale = w, t, s, mean, scale

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Forward-backward over all texts at once, one place of the chain per
        step; texts are sorted by length so that each step works on a prefix.
        Returns P(good) per line, and with ``pairs`` the summed P(a, b) too."""
        odds = np.clip(((x - self.mean) / self.scale) @ self.w, -30, 30).astype(np.float64)
        p1 = 1 / (1 + np.exp(-odds))
        emit = np.stack([1 - p1, p1], axis=1)  # proportional to exp(score)
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, n = first[:-1][order], n[order]
        step = np.exp(self.t)
        alpha = np.empty((len(x), 2))
        steps = int(n[0]) if len(n) else 0
        live = [int(np.searchsorted(-n, -k, "left")) for k in range(steps)]  # texts with more than k lines
        for k in range(steps):
            at = start[:live[k]] + k
            a = (np.exp(self.s) if k == 0 else alpha[at - 1] @ step) * emit[at]
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        beta = np.ones((len(x), 2))
        joint = np.zeros((2, 2))
        for k in range(steps - 2, -1, -1):
            at = start[:live[k + 1]] + k
            ahead = emit[at + 1] * beta[at + 1]
            if pairs:
                both = alpha[at][:, :, None] * step[None] * ahead[:, None, :]
                joint += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ step.T
            beta[at] = b / b.sum(axis=1, keepdims=True)
        m = alpha * beta
        good = m[:, 1] / m.sum(axis=1)
        return (good, joint) if pairs else good


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150) -> Chain:
    """Maximise the conditional likelihood (Adam on its exact gradient, with a
    little weight decay); both kinds of documents weigh the same in sum."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1] = 0
    scale = np.where(scale > 1e-6, scale, 1).astype(np.float32)
    scale[-1] = 1
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2), mean, scale)
    if len(set(label.tolist())) < 2:
        return chain
    z = (x - mean) / scale
    n = np.diff(first)
    line_label = np.repeat(label, n)
    kept = np.array([(n[label == y] - 1).sum() for y in (0, 1)])  # steps inside a state
    lr, m1, m2 = 0.1, None, None
    for r in range(1, rounds + 1):
        good, joint = chain.marginals(x, first, pairs=True)
        gw = z.T @ (line_label - good) / len(x) - 1e-4 * chain.w
        gt = (np.diag(kept) - joint) / max(1, kept.sum()) - 1e-4 * chain.t
        s1 = good[first[:-1]].mean()
        gs = np.array([(label == 0).mean() - (1 - s1), (label == 1).mean() - s1]) - 1e-4 * chain.s
        g = np.concatenate([gw, gt.ravel(), gs])
        m1 = g * 0.1 if m1 is None else 0.9 * m1 + 0.1 * g
        m2 = g * g * 0.001 if m2 is None else 0.999 * m2 + 0.001 * g * g
        d = lr * (m1 / (1 - 0.9 ** r)) / (np.sqrt(m2 / (1 - 0.999 ** r)) + 1e-8)
        k = len(gw)
        chain.w, chain.t, chain.s = chain.w + d[:k], chain.t + d[k:k + 4].reshape(2, 2), chain.s + d[k + 4:]
    return chain


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Chain:
    """Fit on the bounded sample of labelled documents outside the held-out
    fifth; the ids (at most ``train_docs``) are what is broadcast."""
    sample = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
              .where(F.col("doc_id").isNotNull() & F.col("q").isNotNull() & ~held_out())
              .groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label")))
    # of many labels only those whose hash may be among the smallest are ordered
    share = min(1.0, 2 * train_docs / max(1, labels.count()))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    largest = 2 ** 63 - 1 if share == 1 else int(-(2 ** 63) + share * 2 ** 64)
    sample = (sample.where(order <= F.lit(largest))
              .orderBy(order, "doc_id").limit(train_docs))

    def run(batch: pa.RecordBatch):
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for b in blocks(batch.column("text")):
            x, _, first = line_features(b)
            x = with_neighbours(x, first)
            rows = [x[first[i]:first[i + 1]] for i in range(len(b.rows))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[b.rows.start:b.rows.stop].astype(np.int32)),
                 pa.array([r.astype(np.float32).tobytes() for r in rows], pa.binary())], ["label", "x"])

    got = arrow_map(texts(docs).join(F.broadcast(sample), "doc_id").select("label", "text"), run,
                    "label int, x binary").toArrow()
    # rows arrive in no fixed order: sort them, so that reruns agree
    rows = sorted(zip(got["label"].to_pylist(), got["x"].to_pylist(), strict=True))
    xs = [np.frombuffer(x, np.float32).reshape(-1, 3 * N_BASE + 1) for _, x in rows]
    if not xs:
        xs = [np.zeros((1, 3 * N_BASE + 1), np.float32)]
        rows = [(1, b"")]
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return fit(np.concatenate(xs), first, np.array([r[0] for r in rows]))


def _scores(chain: Chain, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(number of lines, score) of each text of a block."""
    x, length, first = line_features(block)
    good = chain.marginals(with_neighbours(x, first), first)
    weight = np.maximum(length, 1).astype(np.float64)
    score = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    return np.diff(first), np.clip(score, 0, 1)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
              train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as
    they are; no row is shuffled."""
    chain = train(docs, labels, train_docs)

    def run(batch: pa.RecordBatch):
        for piece in pieces(batch):
            score = np.concatenate([_scores(chain, b)[1] for b in blocks(piece.column("text").fill_null(""))])
            yield piece.filter(pa.array(score >= threshold))
    return arrow_map(docs, run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, n_lines, score, predicted."""
    chain = train(docs, labels, train_docs)

    def run(batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        for b in blocks(batch.column("text")):
            n_lines, score = _scores(chain, b)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(b.rows.start, len(b.rows)), longs(n_lines), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))], ["doc_id", "n_lines", "score", "predicted"])

    scored = arrow_map(texts(docs), run, "doc_id long, n_lines long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "n_lines", "score", "predicted")
