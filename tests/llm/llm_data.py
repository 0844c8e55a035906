"""Small tables for the operator tests: random texts with planted copies, and
the cases that every operator must take (nulls, empty and long texts, ties,
repeated rows, an empty table, columns with clashing names)."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["h", "uid", "score", "key", "pos", "fp", "n", "token", "doc", "start", "spans", "label", "size", "kept",
            "count", "tokens", "x", "norm", "quota", "item", "url_key", "_spans", "counts", "target"]


def edge_rows() -> list[tuple]:
    long_text = " ".join(f"w{i % 997}x{i % 13}" for i in range(40_000))
    return [(1, None), (2, ""), (3, " \n\t \r\n"), (4, "a"), (5, "one two"), (6, "Ünï çödé 🎉 text"),
            (7, "same words here again and again"), (7, "same words here again and again"),
            (8, "same words here again and again"), (9, "x" * 5000), (10, long_text), (11, long_text),
            (12, "\x00\x01 \x7f"), (13, "line\nline\nline\n\nline"), (None, "no id"), (14, "ab" * 300 + "\n" + "ab" * 300)]


def random_rows(seed: int, n: int = 120, start: int = 100) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choices(vocab, k=40)) for _ in range(5)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and out:
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocab, k=rng.randint(1, 160)))
            if kind > 0.8:
                text += "\n" + rng.choice(passages) + " " + " ".join(rng.choices(vocab, k=5))
        out.append((start + i, text))
    return out


def docs(spark, rows, clash: bool = False):
    full = [(i, t, "en", None if i is None or i % 7 == 0 else f"s{i % 5}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in CLASHING if clash else []:
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
