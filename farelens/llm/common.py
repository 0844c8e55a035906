"""Helpers shared by the operators of this package.

* ``stage_table`` writes a frame as Parquet below the shared scratch folder and
  reads it back: the lineage ends in files that outlive a lost executor.
* ``blocks`` and ``Words`` look at text columns as byte arrays: whole Arrow
  batches are tokenised and hashed with numpy, in blocks of about a quarter of a megabyte,
  so that memory stays bounded and no text becomes a Python string.
* ``bit_sketch`` builds a Bloom-type bitmap of fixed size. It only drops rows
  that cannot match; an exact join follows in every use.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.session import scratch_root

BLOCK_BYTES = 1 << 18
SKETCH_BITS = 1 << 24

# The white space that separates words, and A-Z.
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def stage_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and return the written table."""
    path = f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing is going to read again. A frame that was
    derived from one and is not written itself can't be read after this."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): a null text is the empty text, a row
    without an id is left out (it can't be reported or linked)."""
    return (df.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .where(F.col("doc_id").isNotNull()))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` of each. One table serves all blocks, and a worker keeps it;
    longer texts have a second one."""
    size = BLOCK_BYTES + 1
    while size < n:
        size *= 2
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of ``data`` from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _TABLE[data]
        values *= up[:len(data)]
        np.cumsum(values, dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Block:
    """Some consecutive texts: ``rows`` are their places in the batch, ``data``
    their bytes, ``bounds`` the len(rows) + 1 offsets into ``data``."""

    def __init__(self, rows: range, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds


def blocks(column: pa.Array) -> Iterator[Block]:
    """Cut a string column into blocks of at least one text and, unless one
    text is longer, at most BLOCK_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        to = min(to, n)
        yield Block(range(at, to), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block after lower-casing A-Z:
    ``start``/``end`` in bytes, ``hash`` (64 bits), and ``first``, the index of
    each text's first word (len(rows) + 1 entries)."""

    def __init__(self, block: Block, spaces: np.ndarray = SPACES):
        low = LOWER[block.data]
        inside = ~spaces[low]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        firsts = block.bounds[:-1]
        before[firsts[firsts < len(low)]] = False  # a text's first byte follows nothing
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        lasts = block.bounds[1:] - 1
        after[lasts[lasts >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.low = low
        self.first = np.searchsorted(self.start, block.bounds)
        self.rolling = Rolling(low)
        self.hash = self.rolling.of(self.start, self.end)

    def shingles(self, i: int, width: int) -> np.ndarray:
        """Hashes of text i's runs of ``width`` words, in order; of the whole
        sequence if it has fewer words; none without words."""
        return shingle_hashes(self.hash[self.first[i]:self.first[i + 1]], width)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    width = min(n, width)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k:n - width + 1 + k])
    return out


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def pieces(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, without copying, for work whose arrays are
    many times the size of the texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="farelens-py-")) / "farelens_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))  # Spark serves the file to the executors
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batch) -> iterable of RecordBatch`` over the Arrow batches of df. A worker
    that goes on to another task gives the memory that Arrow keeps back before."""
    ship_package(df.sparkSession)

    def run(it):
        for batch in it:
            if batch.num_rows:
                yield from fn(batch)
        batch = None  # noqa: F841  held until here
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


# --- fixed-size sketches ----------------------------------------------------

def bit_sketch(keys: DataFrame, column: str, bits: int = SKETCH_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits with the places ``key mod bits`` set for all
    values of a long column of well-mixed hashes. At most bits / 32 small rows
    reach the driver, whatever the size of ``keys``."""
    place = F.pmod(F.col(column), F.lit(bits))
    rows = (keys.select(place.alias("p"))
            .groupBy(F.shiftright("p", 5).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b"))
            .toArrow())
    out = np.zeros(bits // 32, np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def in_sketch(sketch: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be present (no key that is present is missed)."""
    place = keys.view(np.uint64) & np.uint64(len(sketch) * 32 - 1)
    word = sketch[(place >> np.uint64(5)).astype(np.int64)]
    return (word >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def maybe_in(sketch: np.ndarray, key) -> Column:
    """True where the long hash column ``key`` may be in the sketch; only that
    column goes to Python."""
    @F.pandas_udf("boolean")
    def test(k: pd.Series) -> pd.Series:
        return pd.Series(in_sketch(sketch, np.ascontiguousarray(k.to_numpy(), np.int64)))
    return test(key)


def mixed_id(column: str = "doc_id"):
    """A well-mixed hash of an id, as ``bit_sketch`` wants it."""
    return F.xxhash64(column)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is among ``ids`` (doc_id). Only
    rows that may be among them are shuffled to the exact anti-join."""
    sketch = bit_sketch(ids.select(mixed_id().alias("k")), "k")
    maybe = maybe_in(sketch, F.xxhash64(F.col("doc_id").cast("long")))
    return docs.where(~maybe).union(docs.where(maybe).join(ids, "doc_id", "left_anti").select(docs.columns))


def most_frequent(counts: DataFrame, at_most: int) -> pa.Table:
    """The rows of ``counts`` (..., n) with the largest n, whole ranges of n at a
    time and at most ``at_most`` of them. A histogram of n picks the range, so
    that nothing is sorted and only rows that are returned reach the driver."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    histogram = counts.where("n > 0").groupBy(level.alias("level")).count().collect()
    cut, total = None, 0
    for row in sorted(histogram, key=lambda r: -r["level"]):
        total += row["count"]
        if total > at_most:
            break
        cut = row["level"]
    return counts.where(F.lit(False) if cut is None else (F.col("n") > 0) & (level >= cut)).toArrow()


# --- connected components ---------------------------------------------------

def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b), for
    every node that has one.

    Alternating large-star and small-star rounds: each round replaces links by
    links to the smallest neighbour, which keeps reachability, and stops when
    nothing changes. Every round aggregates before it joins, so a node with
    very many links is a sum of partial minima and not one task's list; each
    round's links are a written table.
    """
    edges = (links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
             .where("a <> b").distinct())
    edges = stage_table(spark, edges, "links")
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: link the larger neighbours to the smallest of all
        large = stage_table(spark, both.where("b > a").join(low, "a")
                            .select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .where("a <> b").distinct(), "links")
        drop_staged(edges)
        # small star: link the smaller neighbours and the node itself to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = stage_table(spark, down.join(low, "a")
                            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                    F.col("m").alias("b"))
                            .where("a <> b").distinct(), "links")
        drop_staged(large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                          F.count_distinct("a")).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


# --- global positions -------------------------------------------------------

def positions(spark: SparkSession, df: DataFrame, *order) -> DataFrame:
    """``df`` with ``pos``, its 0-based place in the global order: rows are
    range-partitioned and written with their partition's number, then numbered
    within the partition on top of the counts of the earlier ones. Only one row
    per partition is ever ordered in a single task."""
    from pyspark.sql import Window
    parted = stage_table(spark, df.repartitionByRange(*order)
                         .withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (parted.groupBy("_part").count()
             .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy("_part").orderBy(*order)
    return (parted.withColumn("_row", F.row_number().over(within) - 1)
            .join(sizes, "_part")
            .withColumn("pos", F.col("_before") + F.col("_row"))
            .drop("_part", "_row", "_before"))
