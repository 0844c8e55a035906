"""Removal of repeated passages by bucket-pointer refinement of suffixes.

A byte is removed if a string of LENGTH bytes that covers it starts earlier as
well (smaller document, or earlier in the same one). Only buckets of suffixes
that agree to that depth matter, so the refinement stops there, and a bucket of
one suffix is finished at once. Bucket identifiers are hashes of what a bucket
has in common, so that all tasks name a bucket alike without a global sort.

1. Suffix sample. Of every LENGTH-byte window the leftmost smallest GRAM-byte
   string is its anchor; equal windows have equal anchors. A run of windows with
   one anchor is a segment, about one per 30 bytes. Initial buckets hold the
   segments of equal anchor strings; those of one segment are dropped.
2. The buckets are refined by the identifier of the segment's whole extent.
   Segments that agree in it repeat the first of them entirely.
3. A bucket that is still mixed is refined at later offsets of its suffixes:
   windows are taken eight offsets at a time, by the identifier of the 93 bytes
   that the eight share and then by the bytes around these. Equal cells repeat
   the first; a shared part that only one cell has is finished.
4. What is left is refined to single windows on the identifiers found so far.

At each step the first member in document order stays, the others become spans.
Repeats inside an Arrow batch are settled there, so that a passage with a third
of all documents reaches the shuffle once per batch. Spans of a document are
merged and cut out of its text. The bitmaps that let a task skip segments and
documents early have a fixed size and only spare work.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing;
rows that repeat id and text are one document and are each reported; rows of
one id with other texts are ordered by text hash; rows without a doc_id are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import (Block, Rolling, arrow_map, bit_sketch, blocks, in_sketch, longs, maybe_in, mix,
                                 mixed_id, positions, stage_table, texts)

LENGTH = 100
ANCHORS = 64                    # gram places of a window (a power of two)
GRAM = LENGTH - ANCHORS + 1
CELL = 8
SHARED = LENGTH - CELL + 1      # bytes that the windows of a cell have in common
GRAM_BITS = 1 << 26
ODD = np.uint64(0x9E3779B97F4A7C15)


class Segments:
    """The segments of a block: ``gram`` and ``extent`` identifiers, ``text``
    (place in the block), ``start`` in its text, ``shape`` (windows * 64 +
    distance of the anchor from the start)."""

    def __init__(self, block: Block):
        n = len(block.data)
        empty = np.zeros(0, np.uint64)
        self.gram = self.extent = empty
        self.text = self.start = self.shape = empty.astype(np.int64)
        if n < LENGTH:
            return
        r = Rolling(block.data)
        m = n - GRAM + 1
        # 32 bits of the gram's hash, then the place: the smallest is the leftmost of the smallest
        key = (r.sums[GRAM:] - r.sums[:m]) * r.down[:m]
        key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        step = 1
        while step < ANCHORS:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, np.int64)  # windows that end inside their text
        long = np.diff(block.bounds) >= LENGTH
        inside[block.bounds[:-1][long]] += 1
        inside[block.bounds[1:][long] - LENGTH + 1] -= 1
        inside = np.cumsum(inside[:len(anchor)]) > 0
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        firsts = block.bounds[:-1][long]
        new[firsts] = True
        start = np.flatnonzero(new & inside)
        change = np.append(np.flatnonzero(new | ~inside), len(anchor))
        end = change[np.searchsorted(change, start, "right")]  # one behind the last window
        at = anchor[start]
        self.gram = r.of(at, at + GRAM)
        self.extent = mix(r.of(start, end - 1 + LENGTH) + (end - start).astype(np.uint64) + self.gram * ODD)
        self.text = np.searchsorted(block.bounds, start, "right") - 1
        self.start = start - block.bounds[self.text]
        self.shape = (end - start) * 64 + (at - start)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): doc is the place of a document in the order; it is
    the doc_id itself unless one id has several texts."""
    spark = docs.sparkSession
    rows = texts(docs)
    several = (rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
               .where("lo <> hi").limit(1).count())
    if not several:
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    places = stage_table(spark, positions(spark, rows.select("doc_id", "h").distinct(), F.col("doc_id"), F.col("h")), "places")
    return rows.join(places, ["doc_id", "h"]).select(F.col("pos").alias("doc"), "doc_id", "text")


def _grams(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        grams = [Segments(b).gram for b in blocks(batch.column("text"))]
        g, n = np.unique(np.concatenate(grams), return_counts=True)
        yield pa.RecordBatch.from_arrays([longs(g), longs(n)], ["gram", "n"])
    return arrow_map(docs.select("text"), run, "gram long, n long")


def _first_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """(sorting order, is first of its key, repeats the first) in that order;
    rows that repeat doc and place are neither."""
    order = np.lexsort((at, doc, key))
    k, d, a = key[order], doc[order], at[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (a[1:] == a[:-1])
    return order, first, ~first & ~again


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Touching or overlapping intervals of a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.cumsum(np.concatenate([[0], np.where(doc[1:] != doc[:-1], 1, 0)])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] + base[1:] > reach[:-1])
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(doc)) - 1
    return doc[f], start[f], reach[last] - base[last]


def _segment_rows(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Segments in buckets that may be shared: one row for the first of each
    extent in a batch; for repeats inside the batch, merged spans (shape null,
    until the end)."""
    def run(batch: pa.RecordBatch):
        ids = batch.column("doc").to_numpy()
        parts = []
        for b in blocks(batch.column("text")):
            s = Segments(b)
            keep = in_sketch(sketch, s.gram)
            parts.append((s.gram[keep], s.extent[keep], ids[b.rows.start + s.text[keep]], s.start[keep], s.shape[keep]))
        gram, extent, doc, start, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, repeat = _first_of(extent, doc, start)
        f, r = order[first], order[repeat]
        names = ["extent", "gram", "doc", "start", "shape", "until"]
        yield pa.RecordBatch.from_arrays(
            [longs(extent[f]), longs(gram[f]), longs(doc[f]), pa.array(start[f].astype(np.int32)),
             pa.array(shape[f].astype(np.int32)), pa.nulls(len(f), pa.int32())], names)
        d, a, e = _merged(doc[r], start[r], start[r] + shape[r] // 64 - 1 + LENGTH)
        key = mix(d.astype(np.uint64) * ODD + a.astype(np.uint64))  # deals the spans out evenly
        yield pa.RecordBatch.from_arrays(
            [longs(key), pa.nulls(len(d), pa.int64()), longs(d), pa.array(a.astype(np.int32)),
             pa.nulls(len(d), pa.int32()), pa.array(e.astype(np.int32))], names)
    return arrow_map(docs.select("doc", "text"), run,
                     "extent long, gram long, doc long, start int, shape int, until int")


def _cell_rows(docs: DataFrame) -> DataFrame:
    """docs (doc, text, segs) -> cells of the listed segments: the identifier
    ``core`` of the bytes that a cell's windows share, and the bytes before and
    behind; repeats inside the batch as merged spans (core null)."""
    def run(batch: pa.RecordBatch):
        ids, segs = batch.column("doc").to_numpy(), batch.column("segs")
        core, left, right, doc, start, windows = [], [], [], [], [], []
        for b in blocks(batch.column("text")):
            r = Rolling(b.data)
            raw = b.data.tobytes()
            for k, row in enumerate(b.rows):
                list_ = segs[row].values
                gram = list_.field("gram").to_numpy().view(np.uint64)
                s = list_.field("start").to_numpy().astype(np.int64) + b.bounds[k]
                shape = list_.field("shape").to_numpy().astype(np.int64)
                anchor, end = s + shape % 64, s + shape // 64 - 1
                lo, hi = (anchor - end) // CELL, (anchor - s) // CELL
                n = hi - lo + 1
                of = np.repeat(np.arange(len(s)), n)
                c = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
                at = anchor[of] - CELL * c                      # the shared part begins
                first = np.maximum(s[of], at - CELL + 1)
                last = np.minimum(end[of], at)
                behind = at + SHARED
                core.append(mix(r.of(at, behind) + gram[of] * ODD + c.astype(np.uint64)))
                left += [raw[i:j] for i, j in zip(first.tolist(), at.tolist(), strict=True)]
                right += [raw[i:j] for i, j in zip(behind.tolist(), (last + LENGTH).tolist(), strict=True)]
                doc.append(np.full(len(of), ids[row]))
                start.append(first - b.bounds[k])
                windows.append(last - first + 1)
        core, doc, start, windows = (np.concatenate(x) for x in (core, doc, start, windows))
        around = np.array([hash(x) for x in zip(left, right, strict=True)], np.int64).view(np.uint64)
        order, first, repeat = _first_of(mix(core + around * ODD), doc, start)
        f, r = order[first], order[repeat]
        names = ["core", "left", "right", "doc", "start", "until"]
        yield pa.RecordBatch.from_arrays(
            [longs(core[f]), pa.array([left[i] for i in f], pa.binary()), pa.array([right[i] for i in f], pa.binary()),
             longs(doc[f]), pa.array(start[f].astype(np.int32)), pa.nulls(len(f), pa.int32())], names)
        d, a, e = _merged(doc[r], start[r], start[r] + windows[r] - 1 + LENGTH)
        yield pa.RecordBatch.from_arrays(
            [longs(mix(d.astype(np.uint64) * ODD + a.astype(np.uint64))), pa.nulls(len(d), pa.binary()),
             pa.nulls(len(d), pa.binary()), longs(d), pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32))], names)
    return arrow_map(docs, run, "core long, left binary, right binary, doc long, start int, until int")


def _ranked(rows: DataFrame, *key: str) -> DataFrame:
    """Adds ``nth``: 1 for the first of each bucket, in document order. A bucket
    has one row per Arrow batch at most, however many documents share it."""
    return rows.withColumn("nth", F.rank().over(Window.partitionBy(*key).orderBy("doc", "start")))


def _repeated(spark, docs: DataFrame) -> DataFrame:
    """(doc, start, until): spans to remove, not merged yet."""
    shared = _grams(docs).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    sketch = bit_sketch(shared.select("gram"), "gram", GRAM_BITS)

    segments = stage_table(spark, _ranked(_segment_rows(docs, sketch), "extent", "gram").drop("extent"), "segments")
    end = F.coalesce("until", F.col("start") + (F.col("shape") / 64).cast("int") - 1 + LENGTH).alias("until")
    spans = segments.where("nth > 1 or until is not null").select("doc", "start", end)

    firsts = segments.where("nth = 1 and until is null")
    mixed = firsts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    listed = stage_table(spark, firsts.join(mixed, "gram").groupBy("doc").agg(
        F.collect_list(F.struct("gram", "start", "shape")).alias("segs")), "mixed")
    sketch = bit_sketch(listed.select(mixed_id("doc").alias("k")), "k")
    # rows that repeat id and text are one document here
    held = docs.where(maybe_in(sketch, mixed_id("doc"))).groupBy("doc").agg(F.max("text").alias("text"))
    cells = stage_table(spark, _ranked(_cell_rows(held.join(listed, "doc").select("doc", "text", "segs")),
                                       "core", "left", "right"), "cells")
    size = F.length("left") + F.length("right") - CELL + 2  # windows of the cell
    spans = spans.union(cells.where("nth > 1 or until is not null").select(
        "doc", "start", F.coalesce("until", F.col("start") + size - 1 + LENGTH)))

    firsts = cells.where("nth = 1 and until is null").drop("nth", "until")
    mixed = firsts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    j = F.col("j")
    windows = (firsts.join(mixed, "core")
               .select("*", F.explode(F.sequence(CELL - 1 - F.length("right"), F.length("left"))).alias("j"))
               .select("core", "doc", (F.col("start") + F.length("left") - j).alias("start"),
                       F.substring(F.col("left"), F.length("left") - j + 1, j).alias("l"),
                       F.substring(F.col("right"), F.lit(1), CELL - 1 - j).alias("r")))
    key = ["core", "l", "r"]
    lowest = windows.groupBy(*key).agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = (windows.join(lowest.select(*key, "first"), key).where(F.struct("doc", "start") > F.col("first"))
            .select("doc", "start", F.col("start") + LENGTH))
    return spans.union(late)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed documents (doc, doc_id, text), spans (doc, spans) to remove)."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    spans = _repeated(spark, keyed).groupBy("doc").agg(
        F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("until").cast("int").alias("until"))).alias("spans"))
    return keyed, stage_table(spark, spans, "spans")


def _stays(raw: bytes, spans: pa.StructArray | None) -> tuple[bytes, int, int]:
    """(what stays of a text, bytes removed, maximal removed runs)."""
    if spans is None:
        return raw, 0, 0
    a = spans.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    e = spans.field("until").to_numpy(zero_copy_only=False).astype(np.int64)
    _, a, e = _merged(np.zeros(len(a), np.int64), a, e)
    stays = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*a.tolist(), len(raw)], strict=True))
    return stays, int((e - a).sum()), len(a)


def _cut(df: DataFrame) -> DataFrame:
    """(doc_id, text, spans) -> what stays of the bytes and how much went."""
    def run(batch: pa.RecordBatch):
        kept, removed, count = [], [], []
        spans = batch.column("spans")
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            stays, gone, n = _stays(text.as_py(), spans[i].values)
            kept.append(stays)
            removed.append(gone)
            count.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([t.decode("utf-8", "ignore") for t in kept]), pa.array(kept, pa.binary()),
             pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
            ["doc_id", "kept_text", "kept", "n_removed", "n_spans"])
    return arrow_map(df, run, "doc_id long, kept_text string, kept binary, n_removed long, n_spans long")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of text and n_chars counted
    anew; documents (one row per doc_id) stay rows even if nothing is left."""
    _, spans = repeated_spans(docs)
    spans = spans.withColumnRenamed("doc", "doc_id")
    sketch = bit_sketch(spans.select(mixed_id().alias("k")), "k")
    touched = maybe_in(sketch, F.xxhash64(F.col("doc_id").cast("long")))
    hit = docs.where(touched).join(spans.withColumnRenamed("spans", "_spans"), "doc_id", "left")

    def run(batch: pa.RecordBatch):
        text = [None if t is None or s is None else _stays(t, s.values)[0].decode("utf-8", "ignore")
                for t, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_spans"), strict=True)]
        old = batch.column("text").to_pylist()
        out = [o if t is None else t for t, o in zip(text, old, strict=True)]
        names = [c for c in batch.schema.names if c != "_spans"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out, batch.column("text").type) if c == "text" else batch.column(c) for c in names], names)
    schema = [f for f in hit.schema if f.name != "_spans"]
    cut = arrow_map(hit, run, type(hit.schema)(schema)).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(docs.columns).union(docs.where(~touched))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, kept_text (without broken characters at cuts), kept
    (the remaining bytes), n_removed, n_spans. Only texts with spans are
    shuffled; the others pass."""
    keyed, spans = repeated_spans(docs)
    sketch = bit_sketch(spans.select(mixed_id("doc").alias("k")), "k")
    touched = maybe_in(sketch, mixed_id("doc"))
    cut = _cut(keyed.where(touched).join(spans, "doc", "left").select("doc_id", "text", "spans"))
    whole = keyed.where(~touched).select(
        "doc_id", F.col("text").alias("kept_text"), F.col("text").cast("binary").alias("kept"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    return cut.union(whole)
