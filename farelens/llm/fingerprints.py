"""Document fingerprints by one-permutation MinHash.

Every shingle of five words (the whole sequence, if a text has fewer words, be
it none) is hashed once; its low bits choose one of BINS bins, the rest of the
hash competes for the bin's minimum. An empty bin i takes the value of the
first filled bin in a random order of bins that belongs to i alone: the first
few places come from PROBES tables, the rest of the order from a hash of the
two bins (optimal densification). Each bin's value is hashed with the bin's
number, and the low BITS bits are kept and packed, one hex digit a bin. Two fingerprints agree in a bin by chance with
probability 2**-BITS, so their likeness is (share of equal bins - chance) /
(1 - chance), held to 0..1.

All of it is DataFrame expressions over one row's arrays: a document never
leaves its row, and only the edited texts' borrowed beginnings and the packed
fingerprints are shuffled besides the texts themselves.

Defined results: a null text is empty, an empty text has the fingerprint of the
empty sequence; rows that repeat both id and text stand at one place in the
order and are each reported; rows without a doc_id are left out; a lone
document is its own next.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import positions, stage_table, texts

BINS, BITS, SHINGLE, PROBES = 256, 4, 5, 12
BLANK = r"[\x20\x09-\x0D]+"
DIGITS = "0123456789abcdef"


def _probe_tables() -> list[list[int]]:
    return np.random.default_rng(8).integers(0, BINS, (PROBES, BINS)).tolist()


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<tinyint> of BINS packed values of column ``text``."""
    w, s, m, b = (f"_{out}_{x}" for x in "wsmb")
    shift = 63 - int(np.log2(BINS))
    words = F.filter(F.split(F.col(text), BLANK), lambda x: x != "")
    df = df.withColumn(w, words)
    # bin in the high bits, so that sorting lines up each bin's minimum
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))),
                         lambda i: F.xxhash64(F.slice(F.col(w), i, SHINGLE)))
    keyed = F.transform(hashed, lambda v: F.shiftleft(v.bitwiseAND(F.lit(BINS - 1)), shift)
                        .bitwiseOR(F.shiftrightunsigned(v, 64 - shift)))
    df = df.withColumn(s, F.sort_array(keyed))
    minima = F.filter(F.col(s), lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))
    df = df.withColumn(m, F.transform(minima, lambda x: F.struct(
        F.shiftright(x, shift).cast("int").alias("bin"),
        x.alias("v"))))
    none = F.lit(None).cast("long")
    filled = F.flatten(F.transform(F.col(m), lambda x, i: F.concat(
        F.array_repeat(none, x["bin"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(m, i - 1)["bin"]) - 1),
        F.array(x["v"]))))
    df = df.withColumn(b, F.concat(filled, F.array_repeat(none, BINS - 1 - F.element_at(m, -1)["bin"])))
    tables = [_lits(t) for t in _probe_tables()]

    def dense(x, i):
        rest = F.array_min(F.transform(F.col(m), lambda y: F.struct(F.xxhash64(i, y["bin"]).alias("h"), y["v"].alias("v"))))
        value = F.coalesce(x, *[F.get(F.col(b), F.get(t, i)) for t in tables], rest["v"])
        # a value copied to several bins keeps other bits in each, so that chance agreements stay independent
        return F.xxhash64(value, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("tinyint")
    return df.withColumn(out, F.transform(F.col(b), dense)).drop(w, s, m, b)


def packed(sketch: str) -> Column:
    """The sketch as a hex string, BITS bits a digit."""
    digits = _lits(DIGITS)
    return F.array_join(F.transform(sketch, lambda v: F.get(digits, v.cast("int"))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches, without the chance agreement."""
    chance = 2.0 ** -BITS
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text hash, fingerprint) of every document, a map without shuffles."""
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    return with_sketch(rows, "text", "sketch").select("doc_id", "h", packed("sketch").alias("fingerprint"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text has its last
    quarter of code points replaced by the beginning of the next document."""
    spark = docs.sparkSession
    base = texts(docs).withColumn("h", F.xxhash64("text"))
    places = stage_table(spark, positions(spark, base.groupBy("doc_id", "h").agg(
        F.max(F.length("text")).cast("long").alias("n_chars")), F.col("doc_id"), F.col("h")), "places")
    n = places.count()
    follows = places.select(F.pmod(F.col("pos") - 1, F.lit(max(n, 1))).alias("pos"),
                            F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    follows = stage_table(spark, places.join(follows, "pos").drop("pos"), "follows")
    needs = follows.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("for_id"),
                           F.col("h").alias("for_h"), F.floor(F.col("n_chars") / 4).cast("int").alias("k"))
    lent = (base.join(needs, ["doc_id", "h"])
            .select(F.col("for_id").alias("doc_id"), F.col("for_h").alias("h"),
                    F.substring(F.col("text"), F.lit(1), F.col("k")).alias("lent"))
            .groupBy("doc_id", "h").agg(F.max("lent").alias("lent")))
    both = (base.join(lent, ["doc_id", "h"]).withColumn("n_chars", F.length("text"))
            .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1),
                                                       F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int")),
                                           "lent")))
    sketched = with_sketch(with_sketch(both, "text", "d"), "edited", "e")
    done = stage_table(spark, sketched.select("doc_id", "h", F.col("n_chars").cast("long").alias("n_chars"),
                                              F.sha2("edited", 256).alias("edited_sha256"), "d", "e"), "sketches")
    ahead = done.groupBy("doc_id", "h").agg(F.any_value("d").alias("next_d")).join(
        follows.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"),
                       F.col("doc_id").alias("for_id"), F.col("h").alias("for_h")), ["doc_id", "h"]).select(
        F.col("for_id").alias("doc_id"), F.col("for_h").alias("h"), "next_d")
    return done.join(ahead, ["doc_id", "h"]).select(
        "doc_id", "n_chars", "edited_sha256", packed("d").alias("fingerprint"), packed("e").alias("edited_fingerprint"),
        likeness("d", "e").alias("near_edited"), likeness("d", "next_d").alias("near_next"))
