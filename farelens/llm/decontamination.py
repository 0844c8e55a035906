"""Benchmark decontamination by greedy string tiling.

Words are lower-cased in A-Z. Seeds are the runs of MIN_TILE words that a
document shares with a benchmark item. A scan of the documents keeps the runs
of words that may be seeds (a bitmap of fixed size holds the items' seeds); the
kept runs are joined to the seeds exactly, which gives pairs of document and
item. Greedy string tiling covers each pair: the longest common stretch of
words that are not covered yet is marked on both sides, again and again, down
to MIN_TILE words. Stretches are found by running Karp-Rabin: hashes of all
windows of a length that is halved from round to round. Any order of the
passages gives the same tiles, so reordered ones are caught. An item whose words are
covered to COVERAGE or more contaminates the document.

Defined results: a null or empty text, and an item of fewer than MIN_TILE
words, match nothing; items that repeat an id with other texts are items of
their own; an item without an id counts like others and is reported with a null
item_id; rows that repeat a document are each reported; documents without an id
are left out; with an empty benchmark every document is clean; very long texts
are read whole; columns other than the ids and texts are not read, whatever
their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import (Words, arrow_map, bit_sketch, blocks, in_sketch, longs, mix, powers, shingle_hashes,
                                 stage_table, texts)

MIN_TILE = 5
COVERAGE = 0.5


def _lists(xs: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), longs(np.concatenate([np.zeros(0, np.uint64), *xs])))


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words, from one running sum."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)])
    return mix((sums[size:] - sums[:n]) * down[:n])


def greedy_tiles(runs: list[np.ndarray], item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int, int]]:
    """Tiles (run, place in the run, place in the item, words): the longest
    first, ties by place in the item, then run and place."""
    item_free = np.ones(len(item), bool)
    free = [np.ones(len(r), bool) for r in runs]
    tiles = []
    size = max(least, min(len(item), max((len(r) for r in runs), default=0)) // 2)

    def clear(x: np.ndarray, n: int) -> np.ndarray:
        """Places whose next n words are all free."""
        taken = np.concatenate([[0], np.cumsum(~x)])
        return taken[n:] == taken[:-n]

    while len(item) >= least:
        # all maximal stretches of free words of at least this size
        table: dict[int, list[int]] = {}
        ok = clear(item_free, size)
        for i, h in enumerate(_windows(item, size).tolist()):
            if ok[i]:
                table.setdefault(h, []).append(i)
        queue = []
        for r, words in enumerate(runs):
            if len(words) < size:
                continue
            ok = clear(free[r], size)
            for p, h in enumerate(_windows(words, size).tolist()):
                if not ok[p]:
                    continue
                for i in table.get(h, ()):
                    if p and i and free[r][p - 1] and item_free[i - 1] and words[p - 1] == item[i - 1]:
                        continue  # part of the stretch that starts one earlier
                    n = 0
                    while (p + n < len(words) and i + n < len(item) and words[p + n] == item[i + n]
                           and free[r][p + n] and item_free[i + n]):
                        n += 1
                    if n >= size:
                        queue.append((-n, i, r, p))
        heapq.heapify(queue)
        while queue:
            n, i, r, p = heapq.heappop(queue)
            both = free[r][p:p - n] & item_free[i:i - n]
            if both.all():
                tiles.append((r, p, i, -n))
                free[r][p:p - n] = False
                item_free[i:i - n] = False
                continue
            # what is still free of it comes up again
            edge = np.flatnonzero(np.diff(np.concatenate([[0], both.astype(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                if b - a >= size:
                    heapq.heappush(queue, (a - b, i + a, r, p + a))
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def _items(benchmark: DataFrame, least: int) -> DataFrame:
    """(item, item_id, tokens, seeds) of the items of at least ``least`` words."""
    def run(batch: pa.RecordBatch):
        for b in blocks(batch.column("text")):
            w = Words(b)
            tokens = [w.hash[w.first[k]:w.first[k + 1]] for k in range(len(b.rows))]
            keep = [k for k, t in enumerate(tokens) if len(t) >= least]
            if keep:
                rows = pa.array([b.rows.start + k for k in keep])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(rows), batch.column("item_id").take(rows),
                     _lists([tokens[k] for k in keep]),
                     _lists([np.unique(shingle_hashes(tokens[k], least)) for k in keep])],
                    ["item", "item_id", "tokens", "seeds"])
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])
    return arrow_map(rows, run, "item long, item_id long, tokens array<long>, seeds array<long>")


def _runs(docs: DataFrame, sketch: np.ndarray, least: int) -> DataFrame:
    """Per document a row with its n_words (tokens null), and its runs of words
    that lie in possible seeds: start, tokens, and the seeds of the run."""
    def run(batch: pa.RecordBatch):
        ids, keys = batch.column("doc_id"), batch.column("h")
        for b in blocks(batch.column("text")):
            w = Words(b)
            n = len(b.rows)
            names = ["doc_id", "h", "n_words", "start", "tokens", "seeds"]
            none = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [ids.slice(b.rows.start, n), keys.slice(b.rows.start, n), longs(np.diff(w.first)), none(n, pa.int32()),
                 none(n, pa.list_(pa.int64())), none(n, pa.list_(pa.int64()))], names)
            if len(w.hash) < least:
                continue
            seeds = shingle_hashes(w.hash, least)
            hit = np.flatnonzero(in_sketch(sketch, seeds))
            text = np.searchsorted(w.first, hit, "right") - 1
            inside = hit + least <= w.first[text + 1]  # not across two texts
            hit, text = hit[inside], text[inside]
            if not len(hit):
                continue
            new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1])])
            f = np.flatnonzero(new)
            last = np.append(f[1:], len(hit)) - 1
            rows = pa.array(b.rows.start + text[f])
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), keys.take(rows), none(len(f), pa.int64()),
                 pa.array((hit[f] - w.first[text[f]]).astype(np.int32)),
                 _lists([w.hash[hit[a]:hit[z] + least] for a, z in zip(f, last, strict=True)]),
                 _lists([seeds[hit[a]:hit[z] + 1] for a, z in zip(f, last, strict=True)])], names)
    return arrow_map(docs, run, "doc_id long, h long, n_words long, start int, tokens array<long>, seeds array<long>")


def _tiled(pairs: DataFrame, least: int) -> DataFrame:
    def run(batch: pa.RecordBatch):
        out = []
        for runs, item in zip(batch.column("runs").to_pylist(), batch.column("item_tokens").to_pylist(), strict=True):
            runs.sort(key=lambda r: r["start"])
            tiles = greedy_tiles([np.array(r["tokens"], np.int64).view(np.uint64) for r in runs],
                                 np.array(item, np.int64).view(np.uint64), least)
            out.append((sum(t[3] for t in tiles) / len(item), len(tiles)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), batch.column("item_id"),
             pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64())],
            ["doc_id", "h", "item_id", "coverage", "tiles"])
    return arrow_map(pairs, run, "doc_id long, h long, item_id long, coverage double, tiles long")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """Per document: doc_id, n_words, coverage (the highest of any item; 0
    without a shared seed), item_id (of that item, else null), tiles (its
    number of tiles), n_items (items covered to ``coverage``), contaminated."""
    spark = docs.sparkSession
    items = stage_table(spark, _items(benchmark, least), "items")
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    sketch = bit_sketch(seeds.select("seed"), "seed")
    rows = stage_table(spark, _runs(texts(docs).withColumn("h", F.xxhash64("text")), sketch, least), "runs")
    doc = ["doc_id", "h"]
    runs = rows.where("tokens is not null").dropDuplicates([*doc, "start"])
    hits = (runs.select(*doc, "start", F.explode(F.array_distinct("seeds")).alias("seed"))
            .join(seeds, "seed").select(*doc, "item", "start").distinct())
    pairs = (hits.join(runs.select(*doc, "start", "tokens"), [*doc, "start"])
             .groupBy(*doc, "item").agg(F.collect_list(F.struct("start", "tokens")).alias("runs"))
             .join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item"))
    best = _tiled(pairs.select(*doc, "item_id", "runs", "item_tokens"), least).groupBy(*doc).agg(
        F.max(F.struct("coverage", (-F.col("item_id")).alias("minus_id"), "tiles")).alias("b"),
        F.sum((F.col("coverage") >= coverage).cast("long")).alias("n_items"))
    return (rows.where("tokens is null").join(best, doc, "left")
            .select("doc_id", "n_words", F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"),
                    (-F.col("b.minus_id")).alias("item_id"), F.coalesce("b.tiles", F.lit(0)).cast("long").alias("tiles"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(F.col("n_items") > 0, F.lit(False)).alias("contaminated")))
