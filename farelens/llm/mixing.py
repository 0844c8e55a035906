"""Mixing sources to target weights by Sainte-Laguë apportionment.

A document's size is its number of words. Sources, in code point order with
null last, get weights from a repeating list and share ``total`` times all
words; a target stops at ``most`` times its source's size and the excess is
shared again by weight until none is above.

Each source is cut into shards of bounded size by a seeded hash of the
document, so that a source with a third of all rows is many shards. A shard's
documents lie end to end in seeded order and are cut into blocks of equally
many words. Blocks are apportioned to the shards of all sources by highest
quotients, target / (2k + 1); a shard's integer quota then picks its blocks at
even steps from a seeded start, which takes a block floor or ceil(quota /
blocks) times. What a document gives follows from its interval of words alone.

Defined results: a null or empty text has size 0 and gives nothing; a null
source is a source; repeated rows count as rows of their own; rows without a
doc_id are left out; an empty table mixes to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import positions, stage_table

WORD = r"[^\x20\x09-\x0D]+"
SHARD_WORDS = 1 << 18   # words (and empty documents) of a shard, about
BLOCK_WORDS = 256       # words of a block, fewer if a source is small
BLOCKS_AT_LEAST = 200   # blocks that the smallest source is cut into, if it has the words
GRID = 64               # divisors tried in one job


def _targets(spark, sources: DataFrame, total: float, most: float) -> tuple[DataFrame, float]:
    """Adds ``target``; returns the sum to share as well. The level of the
    uncapped (words per weight) rises until no source is newly capped."""
    cap, level = most * F.col("source_size"), 0.0
    share = total * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        above = cap < level * F.col("weight")
        capped, weights = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not weights or (share - (capped or 0.0)) / weights <= level:
            break
        level = (share - (capped or 0.0)) / weights
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap).cast("double")), share


def apportion(cells: DataFrame, seats: int, key: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` divided over the rows of ``cells`` in
    proportion to ``votes`` by the highest quotients votes / (k + 1/2).

    Only sums reach the driver: the seats given out at each of GRID divisors.
    The bracket of divisors narrows until few quotients lie inside; these are
    ranked themselves (ties by key)."""
    votes, given = F.col("votes"), lambda d: F.floor(F.col("votes") / F.lit(d) + 0.5)
    n, total, largest = cells.agg(F.count("*"), F.sum("votes"), F.max("votes")).first()
    if not seats or not total:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    low = total / seats * seats / (seats + n)    # gives out at least the seats
    high = 4 * float(largest) + 1                # gives out none
    at_low = at_high = None
    for _ in range(12):
        steps = [low * (high / low) ** (i / (GRID - 1)) for i in range(GRID)]
        sums = cells.agg(*[F.sum(given(d)) for d in steps]).first()
        i = max(k for k in range(GRID) if sums[k] >= seats or k == 0)
        j = min(i + 1, GRID - 1)
        low, high, at_low, at_high = steps[i], steps[j], sums[i], sums[j]
        if at_low - at_high <= GRID or high / low < 1 + 1e-13:
            break
    inside = (cells.select(*key, votes, given(high).alias("k0"), given(low).alias("k1")).where("k1 > k0")
              .select(*key, "votes", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1)).alias("k"))
              .orderBy((votes / (F.col("k") + 0.5)).desc(), *key).limit(int(seats - at_high))
              .groupBy(*key).agg(F.count("*").alias("more")))
    return (cells.join(inside, key, "left")
            .withColumn("quota", (given(high) + F.coalesce("more", F.lit(0))).cast("long")).drop("more"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5,
                most: float = 2.0, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source),
    taken (words the mix takes, repeats counted)."""
    spark = docs.sparkSession
    sized = stage_table(spark, docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .where("doc_id is not null"), "sizes")
    sources = positions(spark, sized.groupBy("key", "source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") + 1).alias("units")),
        F.col("source").asc_nulls_last())
    sources = stage_table(spark, sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.col("pos") % len(weights) + 1).cast("int"))), "sources")
    sources, share = _targets(spark, sources, total, most)
    sources = stage_table(spark, sources.select(
        "key", "source_size", "target", F.ceil(F.col("units") / SHARD_WORDS).alias("shards")), "targets")
    least = sources.where("source_size > 0").agg(F.min("source_size")).first()[0] or 1
    block = int(max(1, min(BLOCK_WORDS, least // BLOCKS_AT_LEAST)))

    placed = (sized.join(sources, "key")
              .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))))
    cells = placed.groupBy("key", "shard").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("of"), F.first("target").alias("target"))
    cells = stage_table(spark, cells.where("words > 0").select(
        "key", "shard", F.ceil(F.col("words") / block).alias("blocks"),
        (F.col("target") * F.col("words") / F.col("of")).alias("votes")), "cells")
    quotas = stage_table(spark, apportion(cells, round(share / block), ["key", "shard"]).select(
        "key", "shard", "blocks", F.least("quota", (F.col("blocks") * int(most)).cast("long")).alias("quota"),
        F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), F.col("blocks")).alias("start")), "quotas")

    laid = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    spans = (placed.withColumn("to", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
             .join(quotas, ["key", "shard"], "left"))

    def picked(b):  # picks among the blocks before b
        return F.expr(f"({b} * quota + start) div blocks")

    def words(t):   # words of the mix before word t of the shard
        b = f"(({t}) div {block})"
        return picked(b) * block + F.expr(f"({t}) % {block}") * (picked(f"({b} + 1)") - picked(b))

    taken = F.when(F.col("quota").isNull(), F.lit(0)).otherwise(words("`to`") - words("`to` - size"))
    return spans.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
