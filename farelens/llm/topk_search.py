"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers, floor(scale * x). With M the largest norm, a vector v
gets one more coordinate sqrt(M^2 - |v|^2) and a query a zero there: then
|q - v|^2 = |q|^2 + M^2 - 2 q.v, and the largest inner products are the nearest
neighbours, so that the triangle inequality bounds scores.

* Index: pivots are fitted on a bounded sample. Every vector is keyed by its
  nearest pivot and its distance r to it, the vectors are put in the order of
  (pivot, r) and cut into blocks. A block's directory entry has the range
  of r for each of its pivots. Equal keys go on in the order of vec_id, so a very
  common vector is many blocks and not one.
* Search: a query at distance d from a pivot scores at most
  (|q|^2 + M^2 - (d - r)^2) / 2 at r. Queries are put into blocks as well. First each
  query block meets the blocks whose annuli fit its queries best, which gives
  every query a k-th score. Then it meets the blocks whose bound reaches that
  score, and no others. Within a pair of blocks, annuli of some vectors are expanded
  in the order of their bounds, each for the queries that it may still serve, and the
  search stops where no bound reaches a k-th score.

A bound that equals the k-th score is not cut, as ties go to the smaller vec_id.
Bounds are computed in doubles and widened by a margin; scores are exact integers.

Fixed sizes (``Sizes``): the driver holds the sample and the pivots, a task two blocks at
a time.
The directory and the query blocks meet in pieces, by the number of the piece.

Defined results: a vector that is null or has a null or non-finite component
(before or after scaling) takes no part, nor does a row without a vec_id; a shorter
vector counts as padded with zeros, an empty one is all zeros; rows that repeat a
vec_id are rows of their own, each a candidate and, if a query, one for the others;
a score beyond 64 bits counts as the nearest long; fewer candidates than k give
all; an empty table gives none; columns other than vec_id and the vectors are not
read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import arrow_map, longs, positions, ship_package, stage_table

ROUNDS = 5           # of the fit
EXACT = 2.0 ** 53
LONG = 2 ** 63


@dataclass(frozen=True)
class Sizes:
    """Bounds of what the driver and a task hold. Any sizes give the same result."""

    sample: int = 4096        # vectors that the pivots are fitted on, those with the smallest hashes
    pivots: int = 64
    block: int = 1024         # vectors in a block
    queries: int = 1024       # queries in a query block
    ring: int = 256           # vectors in an annulus
    piece: int = 1024         # blocks in a piece of the directory
    together: int = 16        # blocks that a query block meets one after the other


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column -> [rows, width] doubles, zeros behind short rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[rows, pivots] distances; ``last`` is the additional coordinate of x."""
    square = ((x * x).sum(1) + last * last)[:, None] + (pivots * pivots).sum(1) - 2 * (
        x @ pivots[:, :-1].T + last[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(x: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """At most n pivots: far points first, then a few rounds of means."""
    x = np.column_stack([x, last])
    if not len(x):
        return np.zeros((1, x.shape[1]))
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    pivots = x[chosen]
    for _ in range(ROUNDS):
        own = _distances(x[:, :-1], x[:, -1], pivots).argmin(1)
        for k in np.unique(own):
            pivots[k] = x[own == k].mean(0)
    return pivots


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """[queries, vectors] integer inner products, as long."""
    if len(q) and len(v) and math.sqrt((q * q).sum(1).max()) * math.sqrt((v * v).sum(1).max()) >= EXACT:
        whole = [[int(c) for c in row] for row in v]
        out = [[max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(map(int, row), other)))) for other in whole] for row in q]
        return np.array(out, np.int64)
    return (q @ v.T).astype(np.int64)     # every partial sum is below 2**53


def upper_bounds(dist: np.ndarray, norm2: np.ndarray, top: float, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """[queries, annuli]: no vector of the annulus (pivot, lo to hi) scores more."""
    d = dist[:, pivot]
    margin = 1e-6 * (math.sqrt(top) + np.sqrt(norm2))[:, None]
    gap = np.maximum(0, np.maximum(lo - d, d - hi) - margin)
    return (norm2[:, None] + top - gap * gap) / 2 + 1e-9 * (norm2[:, None] + top) + 1


class Search:
    """One query block against blocks, annulus by annulus. ``floor``: scores
    below it are of no use to the query (its k-th score so far)."""

    def __init__(self, k: int, queries: dict, pivots: np.ndarray, top: float, floor: np.ndarray, ring: int):
        self.k, self.q, self.top, self.floor, self.ring = k, queries, top, floor.copy(), ring
        n = len(floor)
        self.norm2 = (queries["vec"] ** 2).sum(1)
        self.dist = _distances(queries["vec"], np.zeros(n), pivots)
        self.score, self.id, self.found = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def meet(self, block: dict) -> None:
        rings = []
        for lo in range(0, len(block["id"]), self.ring):
            own = block["pivot"][lo:lo + self.ring]
            cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            rings += [(lo + a, lo + b) for a, b in zip(cuts[:-1], cuts[1:])]
        at = np.array(rings)
        bound = upper_bounds(self.dist, self.norm2, self.top, block["pivot"][at[:, 0]],
                             block["dist"][at[:, 0]], block["dist"][at[:, 1] - 1])
        for r in np.argsort(-bound.max(0), kind="stable"):
            use = np.flatnonzero(~(bound[:, r] < self.floor))
            if len(use):
                self.expand(block, *rings[r], use)

    def expand(self, block: dict, lo: int, hi: int, use: np.ndarray) -> None:
        s = scores(self.q["vec"][use], block["vec"][lo:hi])
        enough = (self.q["row"][use][:, None] != block["row"][lo:hi]) & (s >= self.floor[use][:, None])
        some = enough.any(1)
        use, s, enough = use[some], s[some], enough[some]
        if not len(use):
            return
        score = np.concatenate([self.score[use], s], axis=1)
        ids = np.concatenate([self.id[use], np.broadcast_to(block["id"][lo:hi], s.shape)], axis=1)
        found = np.concatenate([self.found[use], enough], axis=1)
        order = np.lexsort((ids, ~score, ~found), axis=1)[:, :self.k]   # ~: the order of -score, in range
        self.score[use], self.id[use], self.found[use] = (np.take_along_axis(x, order, 1) for x in (score, ids, found))
        full = use[self.found[use, -1]]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])

    def rows(self, first: int) -> pa.RecordBatch:
        """(place, query_id, vec_id, score); ``first``: the block's first place."""
        i, j = np.nonzero(self.found)
        return pa.RecordBatch.from_arrays(
            [longs(first + i), longs(self.q["id"][i]), longs(self.id[i, j]), longs(self.score[i, j])],
            ["place", "query_id", "vec_id", "score"])


_BLOCK_ROW = "row binary, id binary, pivot binary, dist binary, vec binary"


def _packed(rows: DataFrame, name: str, size: int, width: int) -> DataFrame:
    """Blocks of ``size`` consecutive places, a row each: the block's number and
    its columns as bytes."""
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        columns = {c: table[c].to_numpy().astype(np.int64) for c in ("row", "id", "pivot")}
        columns |= {"dist": table["dist"].to_numpy(), "vec": _matrix(table["vec"], width)}
        return pa.table({name: pa.array([table[name][0].as_py()], pa.int64()),
                         **{c: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for c, x in columns.items()}})
    return rows.withColumn(name, F.floor(F.col("place") / size)).groupBy(name).applyInArrow(pack, f"{name} long, {_BLOCK_ROW}")


def _unpacked(row: dict, prefix: str = "") -> dict:
    """A block row's arrays."""
    out = {c: np.frombuffer(row[prefix + c], np.int64) for c in ("row", "id", "pivot")}
    n = len(out["id"])
    return out | {"dist": np.frombuffer(row[prefix + "dist"]), "vec": np.frombuffer(row[prefix + "vec"]).reshape(n, -1)}


def _floors(row: dict, n: int, size: int) -> np.ndarray:
    """The queries' k-th scores so far; none: anything is of use."""
    out = np.full(n, -np.inf)
    for x in row["floors"] or []:
        out[x["place"] - row["qblock"] * size] = x["floor"]
    return out


def _each_row(fn):
    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            yield from fn(batch.slice(i, 1).to_pylist()[0])
    return run


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    vec = F.transform(F.col(vec_col), lambda x: _floor(x.cast("double") * F.lit(float(scale))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad)


def _floor(x: Column) -> Column:
    """floor as a double: from 2**53 on a double is whole, and a long may not hold it."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
                id_col: str = "vec_id", vec_col: str = "embedding", sizes: Sizes = Sizes()) -> DataFrame:
    """Per query row and rank (1 to k): query_id, rank, vec_id, score.
    ``is_query`` is a condition on the column ``id``, the row's vec_id."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = stage_table(spark, integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    top, width, n_rows = rows.agg(F.max(norm2), F.max(F.size("vec")), F.count("*")).first()
    top, width = float(top or 0), max(int(width or 0), 1)
    x = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sizes.sample).select("vec").toArrow()["vec"], width)
    pivots = fit_pivots(x, _last(x, top), sizes.pivots)

    def keyed(df: DataFrame, query: bool) -> DataFrame:
        def run(batch: pa.RecordBatch):
            x = _matrix(batch.column("vec"), width)
            dist = _distances(x, np.zeros(len(x)) if query else _last(x, top), pivots)
            own = dist.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, longs(own), pa.array(dist[np.arange(len(x)), own])],
                                             [*batch.schema.names, "pivot", "dist"])
        types = ", ".join(f"{c} {t}" for c, t in df.dtypes)
        return arrow_map(df, run, f"{types}, pivot long, dist double")

    # the index: a row's place is its row number from here on
    index = stage_table(spark, positions(spark, keyed(rows, False), "pivot", "dist", "id")
                        .withColumn("place", F.col("pos")).withColumnRenamed("pos", "row"), "index")
    blocks = stage_table(spark, _packed(index, "block", sizes.block, width), "blocks")
    block = F.floor(F.col("place") / sizes.block)
    directory = (index.groupBy(block.alias("block"), "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
                 .groupBy(F.floor(F.col("block") / sizes.piece).alias("piece"))
                 .agg(F.collect_list(F.struct("block", "pivot", "lo", "hi")).alias("entries")))
    pieces = -(-n_rows // (sizes.block * sizes.piece))
    asked = positions(spark, keyed(index.where(is_query).select("row", "id", "vec"), True), "pivot", "dist", "id", "row")
    queries = stage_table(spark, _packed(asked.withColumnRenamed("pos", "place"), "qblock", sizes.queries, width), "queries")

    def pairs(queries: DataFrame, seeds: bool) -> DataFrame:
        """(qblock, block): the blocks that fit a query block's queries best, or
        those that hold something of use to one of them."""
        def choose(row: dict):
            q = _unpacked(row)
            floor = _floors(row, len(q["id"]), sizes.queries)
            entry = {c: np.array([e[c] for e in row["entries"]]) for c in ("block", "pivot", "lo", "hi")}
            dist = _distances(q["vec"], np.zeros(len(floor)), pivots)
            bound = upper_bounds(dist, (q["vec"] ** 2).sum(1), top, entry["pivot"], entry["lo"], entry["hi"])
            if seeds:   # of equal bounds the annulus with the middle nearest to the query
                off = np.abs(dist[:, entry["pivot"]] - (entry["lo"] + entry["hi"]) / 2)
                own = np.lexsort((off, -bound), axis=1)[:, 0]
            else:
                own = ~(bound < floor[:, None]).all(0)
            found = np.unique(entry["block"][own])
            yield pa.RecordBatch.from_arrays([longs(np.full(len(found), row["qblock"])), longs(found)], ["qblock", "block"])
        met = queries.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(max(pieces - 1, 0))))).join(directory, "piece")
        return arrow_map(met, _each_row(choose), "qblock long, block long")

    groups = -(-n_rows // (sizes.block * sizes.together)) or 1

    def searched(queries: DataFrame, chosen: DataFrame) -> DataFrame:
        """(place, query_id, vec_id, score): the best of each query block and
        group of blocks, whose pairs a merge join puts one behind the other."""
        def search(batches):
            at, state = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if row["qblock"] != at:
                        if state:
                            yield state.rows(at * sizes.queries)
                        at, q = row["qblock"], _unpacked(row, "q_")
                        state = Search(k, q, pivots, top, _floors(row, len(q["id"]), sizes.queries), sizes.ring)
                    state.meet(_unpacked(row))
            if state:
                yield state.rows(at * sizes.queries)
        named = queries.select("qblock", "floors", *[F.col(c).alias(f"q_{c}") for c in ("row", "id", "pivot", "dist", "vec")],
                               F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        met = (chosen.withColumn("group", (F.col("block") % groups).cast("int")).join(blocks, "block")
               .join(named.hint("merge"), ["qblock", "group"]))
        return met.mapInArrow(search, "place long, query_id long, vec_id long, score long")

    by_score = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    unknown = queries.withColumn("floors", F.lit(None).cast("array<struct<place: bigint, floor: bigint>>"))
    first = stage_table(spark, pairs(unknown, True), "seeds")
    found = stage_table(spark, best(searched(unknown, first)), "found")
    floors = (found.where(F.col("rank") == k).select("place", F.col("score").alias("floor"))
              .groupBy(F.floor(F.col("place") / sizes.queries).alias("qblock"))
              .agg(F.collect_list(F.struct("place", "floor")).alias("floors")))
    bounded = stage_table(spark, queries.join(floors, "qblock", "left"), "bounded")
    rest = stage_table(spark, pairs(bounded, False).join(first, ["qblock", "block"], "left_anti"), "rest")
    return best(found.drop("rank").union(searched(bounded, rest))).select("query_id", "rank", "vec_id", "score")


def _last(x: np.ndarray, top: float) -> np.ndarray:
    """The additional coordinate of vectors."""
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0))
