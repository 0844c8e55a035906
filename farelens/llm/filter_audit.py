"""How five quality filters interact, for every order of applying them.

A row's five verdicts make a mask of five bits. Rows are counted into cells of
(part, mask), at most 32 for a part; only cells go further. Each cell folds
across the array of the 120 orders, which travels with the plan: ``aggregate``
walks the five steps of an order with the filters seen so far, ``transform``
does so for all orders, and 600 structs come out, weighted by the cell's rows.
The structs of a part's cells are summed element by element.

Whether a text is a copy (filter E) is judged by its SHA-256 over the whole
table: the smallest doc_id of a text is a grouped minimum, so a text that a third
of all rows share costs one row per task. Rows meet that minimum on (text,
doc_id), a key that copies don't share.

Defined results: a null text is empty; a null source and the empty source are
one part; a row without a doc_id counts, is no copy and makes none, and has no
labels; rows that repeat the smallest doc_id of a text are no copies; a document
is good (toxic) if any of its label rows says so; parts without rows have no
result, so empty tables give none; very long texts are read whole, a row at a
time; columns other than doc_id, text and source (labels: doc_id, quality,
toxic) are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import stage_table

# The filters' letters and limits.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
MARKS = "[#$%&*|]"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_STEPS = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of A to D, which a text fails by itself."""
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.split(inner, r"[\x20\x09-\x0D]+")
    n = F.when(inner == "", 0).otherwise(F.size(words))
    distinct = F.when(inner == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n,
             100 * capitals > MAX_CAPITALS_PERCENT * F.length(text), text.rlike(MARKS))
    mask = F.lit(0)
    for letter, fail in zip(FILTERS, fails):
        mask = mask.bitwiseOR(F.when(fail, _bit(letter)).otherwise(0))
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and failed filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = stage_table(docs.sparkSession, rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask")), "masks")
    firsts = (rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
              .withColumn("first", F.lit(True)))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), _bit("E")).otherwise(0)
    return (rows.join(firsts, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
            .groupBy("part", F.col("mask").bitwiseOR(copy).alias("mask"))
            .agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
                 F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")))


def fold_orders(cell: Column) -> Column:
    """The 600 weighted structs of one cell (mask, n, good, toxic), the five
    steps of each order one after the other."""
    orders = F.array(*[F.array(*[F.lit(_bit(f)) for f in order]) for order in ORDERS])

    def step(done: Column, bit: Column) -> Column:
        alive = cell["mask"].bitwiseAND(done["seen"]) == 0
        fails = cell["mask"].bitwiseAND(bit) != 0

        def when(condition, weight):
            return F.when(condition, cell[weight]).otherwise(F.lit(0).cast("long"))
        counts = F.struct(when(alive & ~fails, "n").alias("kept"), when(alive & fails, "n").alias("removed"),
                          when(~alive & fails, "n").alias("redundant"),
                          when(cell["mask"] == bit, "n").alias("unique_fails"),
                          when(alive & fails, "good").alias("good_lost"), when(alive & fails, "toxic").alias("toxic_lost"))
        return F.struct(done["seen"].bitwiseOR(bit).alias("seen"), F.concat(done["steps"], F.array(counts)).alias("steps"))
    start = F.struct(F.lit(0).alias("seen"), F.array().cast(_STEPS).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda done: done["steps"])))


def _summed(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step (1 to 5): part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley, what the step's filter removes in all orders."""
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))     # at most 32
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS))
    parts = (mask_cells(docs, labels).groupBy("part").agg(cells.alias("cells"))
             .select("part", F.aggregate("cells", zeros, lambda total, cell: _summed(total, fold_orders(cell))).alias("steps")))
    filters = F.array(*[F.lit(FILTERS.index(f)) for order in ORDERS for f in order])
    shapley = F.transform(F.array(*[F.lit(k) for k in range(len(FILTERS))]), lambda k: F.aggregate(
        F.zip_with("steps", filters, lambda x, f: F.when(f == k, x["removed"]).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, x: s + x))
    out = parts.withColumn("by_filter", shapley).select("part", "by_filter", F.posexplode("steps").alias("place", "x"))
    width = len(FILTERS)
    return out.select("part", F.element_at(F.array(*[F.lit(o) for o in ORDERS]), (F.col("place") / width).cast("int") + 1)
                      .alias("filter_order"), (F.col("place") % width + 1).cast("int").alias("step"),
                      *[F.col(f"x.{c}").alias(c) for c in COUNTS],
                      F.element_at("by_filter", F.element_at(filters, F.col("place") + 1) + 1).alias("shapley"))
