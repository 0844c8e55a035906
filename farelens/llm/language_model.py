"""Language-model scoring by context-tree weighting over bytes.

The model predicts the bytes of the lower-cased text. A byte is eight binary
decisions, one for each node of a binary tree over its bits; a decision's
context is that node and the 0 to DEPTH bytes before. At every (context, node)
a Krichevsky-Trofimov estimate counts zeros and ones, and the estimates of all
depths are mixed with the weights of context-tree weighting: the weighted
probability of a context is half its own estimate's and half the product of its
children's, which gives the posterior weight of stopping at each depth.

All training bytes are counted, as (DEPTH + 1)-byte strings, and every context
of them is in the tree, which is a set of staged tables with one row for each
(context, node): counts and weighted probabilities go up from the longest
contexts, one sum over the parent per depth, and mixed predictions come down,
one join with the parent per depth. A (context, node) has at most 256 children,
so no key of these is larger. Strings that only held-out texts have are in the
tables with count 0, so that each byte of each text has its row: a node without
counts predicts 1/2 at its depth and at all below.

The log probabilities of the most frequent strings, GRAMS at most, are looked up
in the task; the texts' other strings meet theirs in a join.

The base score is an add-one unigram score of words and one end per text, from
the exact counts of all training words. The most frequent words, DICTIONARY at
most, are looked up in the task, the others meet their counts in a join.

Defined results: a null text is empty, and an empty text is its end alone
(n_tokens 1, score 0); repeated rows are counted and scored each; rows without
a doc_id are left out; without any training row all counts are 0 and every byte
costs 8 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import LOWER, Block, Words, arrow_map, blocks, longs, mix, most_frequent, pieces, stage_table, texts

DEPTH = 5
GRAMS = 1 << 21
DICTIONARY = 1 << 18
PIECE_ROWS = 2000             # of a batch that are counted together
WORD, GRAM, TEXT = 0, 1, 2   # kinds of counted things


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2


def _grams(block: Block) -> np.ndarray:
    """The byte at each place with the DEPTH bytes before it (0 before the
    text), the nearest in the lowest byte of the context."""
    low = LOWER[block.data].astype(np.uint64)
    out = low.copy()
    starts = block.bounds[:-1]
    for k in range(1, DEPTH + 1):
        shifted = np.zeros_like(low)
        shifted[k:] = low[:-k] if k < len(low) else low[:0]
        for j in range(k):  # places with fewer than k bytes before them in their text
            at = starts + j
            shifted[at[at < block.bounds[1:]]] = 0
        out |= shifted << np.uint64(8 * k)
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n): words by hash, byte strings, and texts, with their number
    in the training rows. Byte strings of the held-out rows are there too. A task
    sums up parts of a batch, so that its arrays stay some times 5 MB."""
    def run(batch: pa.RecordBatch):
        for piece in pieces(batch, PIECE_ROWS):
            yield from count(piece)

    def count(batch: pa.RecordBatch):
        found = {WORD: ([], []), GRAM: ([], [])}
        train = batch.column("train").to_numpy(zero_copy_only=False)
        for b in blocks(batch.column("text")):
            w, learn = Words(b), train[b.rows.start:b.rows.stop]
            for kind, x, bounds in ((WORD, w.hash, w.first), (GRAM, _grams(b), b.bounds)):
                counted = np.repeat(learn, np.diff(bounds))
                key, n = np.unique(x[counted], return_counts=True)
                found[kind][0].append(key)
                found[kind][1].append(n)
                if kind == GRAM and not counted.all():
                    key = np.unique(x[~counted])
                    found[kind][0].append(key)
                    found[kind][1].append(np.zeros(len(key), n.dtype))
        for kind, (keys, counts) in found.items():
            key, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), longs(key), longs(n)],
                                             ["kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([TEXT], pa.int32()), pa.array([0], pa.int64()),
                                          pa.array([int(train.sum())], pa.int64())], ["kind", "key", "n"])
    return (arrow_map(rows.select("text", held_out().alias("held")).select("text", (~F.col("held")).alias("train")),
                      run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _kt(z: Column, o: Column) -> Column:
    """log of the Krichevsky-Trofimov probability of z zeros and o ones."""
    def log_gamma(x):
        shift = x
        for k in range(1, 8):
            shift = shift * (x + k)
        y = x + 8
        return ((y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
                + 1 / (1260 * y * y * y * y * y) - F.ln(shift))
    z, o = z.cast("double"), o.cast("double")
    return F.when(z + o > 0, log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1) - math.log(math.pi)).otherwise(0.0)


def gram_scores(grams: DataFrame) -> DataFrame:
    """(key, n, logp) from (key, n): the log10 probability of each byte string's
    last byte behind the others, from the tree of all contexts. Every string of
    ``grams`` is there, and strings that differ from one in the last bit."""
    spark = grams.sparkSession
    # a row's key is its context with the node in the lowest byte, so that the
    # parent's key is the lowest 8 * depth bits
    bits = grams.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        F.expr("(key - (key & 255L)) | shiftleft(1L, k) | shiftright(key & 255L, 8 - k)").alias("node"),
        F.expr("if(shiftright(key, 7 - k) & 1 = 0, n, 0L)").alias("z"),
        F.expr("if(shiftright(key, 7 - k) & 1 = 1, n, 0L)").alias("o"))
    levels: list = [None] * (DEPTH + 1)
    level = bits.groupBy("node").agg(F.sum("z").alias("z"), F.sum("o").alias("o"))
    level = level.withColumn("weighted", _kt(F.col("z"), F.col("o"))).withColumn("stop", F.lit(1.0))
    half = math.log(0.5)
    for d in range(DEPTH, -1, -1):
        levels[d] = stage_table(spark, level.select("node", "z", "o", "weighted", "stop"), "level")
        up = (levels[d].groupBy(F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("node"))
              .agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("weighted").alias("below"))
              .withColumn("own", _kt(F.col("z"), F.col("o"))))
        level = (up.withColumn("weighted", half + F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))))
                 .withColumn("stop", F.exp(half + F.col("own") - F.col("weighted"))))
    share = (F.col("o") + 0.5) / (F.col("z") + F.col("o") + 1)
    mixed = levels[0].select("node", (F.col("stop") * share).alias("mixed"), (1 - F.col("stop")).alias("left"))
    for d in range(1, DEPTH + 1):
        above = mixed.select(F.col("node").alias("parent"), "mixed", "left")
        if d <= 2:   # at most 255 and 255 * 256 rows, however large the corpus is
            above = F.broadcast(above)
        at = levels[d].withColumn("parent", F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(above, "parent")
        mixed = at.select("node", "z", "o", (F.col("mixed") + F.col("left") * F.col("stop") * share).alias("mixed"),
                          (F.col("left") * (1 - F.col("stop"))).alias("left"))
    nodes = (mixed.select(F.shiftright("node", 8).alias("context"), F.struct(
        F.col("node").bitwiseAND(F.lit(255)).cast("int").alias("node"), "z", "o", F.col("mixed").alias("p")).alias("x"))
        .groupBy("context").agg(F.collect_list("x").alias("x")))

    def run(batch: pa.RecordBatch):
        for piece in pieces(batch, PIECE_ROWS):
            yield from last_bits(piece)

    def last_bits(batch: pa.RecordBatch):
        lists = batch.column("x")
        x = lists.flatten()
        node, z, o, p = (x.field(c).to_numpy(zero_copy_only=False) for c in ("node", "z", "o", "p"))
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        place = row * 256 + node
        order = np.argsort(place)
        place, p = place[order], np.clip(p[order], 1e-12, 1 - 1e-12)
        low = np.flatnonzero(node >= 128)   # the nodes of the last bit: two strings each
        zero, one = np.log10(1 - p), np.log10(p)
        path = np.zeros(len(low))
        for k in range(7):
            at = np.searchsorted(place, row[low] * 256 + (node[low] >> (7 - k)))
            path += np.where((node[low] >> (6 - k)) & 1, one[at], zero[at])
        at = np.searchsorted(place, row[low] * 256 + node[low])
        context = batch.column("context").to_numpy()[row[low]]
        for bit, n, last in ((0, z, zero), (1, o, one)):
            byte = ((node[low] & 127) << 1) | bit
            yield pa.RecordBatch.from_arrays([longs((context << 8) | byte), longs(n[low]), pa.array(path + last[at])],
                                             ["key", "n", "logp"])
    return stage_table(spark, arrow_map(nodes, run, "key long, n long, logp double"), "grams")


class Lookup:
    """A hash table of keys below 2**64 - 1, each in one of PROBES places; a key
    whose places are all taken is left out."""

    PROBES = 8
    EMPTY = np.uint64(2 ** 64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 16
        while size < 2 * len(keys):
            size *= 2
        self.keys, self.values = np.full(size, self.EMPTY), np.zeros(size, np.float64)
        open_ = np.arange(len(keys))
        for j in range(self.PROBES):
            slot = self._slot(keys[open_], j)
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = keys[open_[free]]
            got = self.keys[slot] == keys[open_]
            self.values[slot[got]] = values[open_[got]]
            open_ = open_[~got]

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((mix(keys) + np.uint64(probe)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is the key there, its value or 0)."""
        slot = self._slot(keys, 0)
        hit = self.keys[slot] == keys
        out = np.where(hit, self.values[slot], 0.0)
        open_ = np.flatnonzero(~hit)
        for j in range(1, self.PROBES):
            slot = self._slot(keys[open_], j)
            found = self.keys[slot] == keys[open_]
            hit[open_[found]] = True
            out[open_[found]] = self.values[slot[found]]
            open_ = open_[~found & (self.keys[slot] != self.EMPTY)]
        return hit, out


def score_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    rows = texts(docs)
    counts = stage_table(spark, corpus_counts(rows), "counts")
    grams = gram_scores(counts.where(F.col("kind") == GRAM).select("key", "n"))
    often = most_frequent(grams, GRAMS)
    lookup = spark.sparkContext.broadcast(
        Lookup(often["key"].to_numpy().astype(np.int64).view(np.uint64), often["logp"].to_numpy()))
    del often
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    all_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = counts.where(F.col("kind") == TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_train, n_distinct = all_words + n_texts, distinct + (n_texts > 0)
    top = most_frequent(words, DICTIONARY)
    order = np.argsort(top["word"].to_numpy().astype(np.int64).view(np.uint64))
    known = top["word"].to_numpy().astype(np.int64).view(np.uint64)[order]
    log_known = np.log10(top["n"].to_numpy().astype(np.float64) + 1)[order]
    dictionary = spark.sparkContext.broadcast((known, log_known))
    whole = distinct <= DICTIONARY  # then a word that is not in the dictionary has no count

    def per_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]]

    def rare(uid: np.ndarray, kind: int, first: np.ndarray, key: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        """The keys that were not found, once per text, with their number."""
        text = np.searchsorted(first, np.flatnonzero(~hit), "right") - 1
        key = key[~hit]
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])]))
        m = len(new)
        return pa.RecordBatch.from_arrays(
            [longs(uid[text[new]]), *[pa.nulls(m, t) for t in (
                pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())],
             pa.array(np.full(m, kind, np.int32)), longs(key[new]), longs(np.diff(np.append(new, len(text))))], names)

    names = ["uid", "doc_id", "n_words", "n_known", "logs", "score", "n_bytes", "kind", "key", "times"]

    def run(batch: pa.RecordBatch):
        (known, log_known), model = dictionary.value, lookup.value
        ids, uid = batch.column("doc_id"), batch.column("uid").to_numpy()
        for b in blocks(batch.column("text")):
            w, n = Words(b), len(b.rows)
            at = np.minimum(np.searchsorted(known, w.hash), max(len(known) - 1, 0))
            hit = known[at] == w.hash if len(known) else np.zeros(len(w.hash), bool)
            logs = np.where(hit, log_known[at], 0.0) if len(known) else np.zeros(len(w.hash))
            gram = _grams(b)
            found, p = model.get(gram)
            own = uid[b.rows.start:b.rows.stop]
            yield pa.RecordBatch.from_arrays(
                [longs(own), ids.slice(b.rows.start, n), longs(np.diff(w.first)),
                 longs(per_text(hit, w.first).astype(np.int64)), pa.array(per_text(logs, w.first)),
                 pa.array(per_text(p, b.bounds)), longs(np.diff(b.bounds)), pa.nulls(n, pa.int32()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            if not whole and not hit.all():
                yield rare(own, WORD, w.first, w.hash, hit)
            if not found.all():
                yield rare(own, GRAM, b.bounds, gram, found)

    scored = stage_table(spark, arrow_map(
        rows.withColumn("uid", F.monotonically_increasing_id()), run,
        "uid long, doc_id long, n_words long, n_known long, logs double, score double, n_bytes long, "
        "kind int, key long, times long"), "scored")
    lookup.unpersist()        # the table is written: the workers need not hold them any longer
    dictionary.unpersist()
    more = (scored.where(F.col("kind") == WORD).join(words.withColumnRenamed("word", "key"), "key")
            .select("uid", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("n") + 1)).alias("logs"),
                    F.lit(0.0).alias("score"))
            .union(scored.where(F.col("kind") == GRAM).join(grams, "key")
                   .select("uid", F.lit(0).cast("long"), F.lit(0.0), F.col("times") * F.col("logp")))
            .groupBy("uid").agg(F.sum("known").alias("more_known"), F.sum("logs").alias("more_logs"),
                                F.sum("score").alias("more_score")))
    n_tokens = F.col("n_words") + 1
    return (scored.where("kind is null").join(more, "uid", "left")
            .withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
            .select("doc_id", held_out().alias("held_out"), n_tokens.alias("n_tokens"),
                    (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_texts > 0))).alias("n_known"),
                    F.lit(int(n_train)).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(math.log10(n_texts + 1))
                     - n_tokens * F.lit(math.log10(n_train + n_distinct + 1))).alias("base_score"),
                    "score", "n_bytes",
                    F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")))
