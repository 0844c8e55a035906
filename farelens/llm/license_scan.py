"""License scanning with ordered signature rules.

A signature rule is a regex over the document's words, its keyword, a label, a
priority and a confidence. The table of rules is written out per license family
(name forms x version forms x introducing phrases), some three hundred in all.
A first pass over the whole text looks for any keyword; only texts that hold
one are normalised to their words joined by single blanks, and a rule's regex
runs only where its own keyword occurs. Detections are intervals of the
normalised text. An interval that lies inside one of higher priority, or inside
a longer one of the same priority, is suppressed (equal intervals: the rule
earlier in the table stays). The score is 1 minus the product of (1 -
confidence) over the distinct labels that stay.

Base phrases are counted apart from that, at every place, and their labels are
never suppressed.

Defined results: a null or empty text has 0 words and places, null first and
last word, empty labels and score 0; repeated rows are scanned each; rows
without a doc_id are left out. Very long texts and texts of many thousands of
detections are scanned whole. An empty table gives an empty result; other columns
than doc_id and text are ignored, whatever their names. Only A-Z are folded to lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their base labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Fixed value: a word after lower-casing A-Z is a run of other characters than these.
NOT_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
IN_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INTRO = r"(?:licen[cs]ed under|released under|distributed under|available under|subject to|under|terms of)(?: the)?(?: terms of)?(?: the)?"
V = r"(?: license)?(?: version| ?v)? ?"  # also glued: gplv2

# Families: label, keyword, name forms (regex over words), versions (suffix of the label, regex).
FAMILIES = [
    ("apache", "apache", [r"apache license", r"apache software license", r"apache"],
     [("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?")]),
    ("gpl", "general public", [r"gnu general public license", r"general public license"],
     [("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?"), ("3.0", "3(?: 0)?")]),
    ("gpl", "gpl", [r"gnu gpl", r"gpl"],
     [("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?"), ("3.0", "3(?: 0)?")]),
    ("lgpl", "lesser general", [r"gnu lesser general public license", r"lesser general public license"],
     [("2.1", "2 1"), ("3.0", "3(?: 0)?")]),
    ("lgpl", "lgpl", [r"gnu lgpl", r"lgpl"], [("2.0", "2(?: 0)?"), ("2.1", "2 1"), ("3.0", "3(?: 0)?")]),
    ("agpl", "affero", [r"gnu affero general public license", r"affero general public license"],
     [("1.0", "1(?: 0)?"), ("3.0", "3(?: 0)?")]),
    ("agpl", "agpl", [r"gnu agpl", r"agpl"], [("3.0", "3(?: 0)?")]),
    ("mpl", "mozilla", [r"mozilla public license"], [("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?")]),
    ("epl", "eclipse", [r"eclipse public license"], [("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?")]),
    ("cddl", "development and distribution", [r"common development and distribution license"],
     [("1.0", "1 0"), ("1.1", "1 1")]),
    ("eupl", "european union public", [r"european union public licen[cs]e"],
     [("1.0", "1 0"), ("1.1", "1 1"), ("1.2", "1 2")]),
    ("osl", "open software license", [r"open software license"], [("1.0", "1 0"), ("2.1", "2 1"), ("3.0", "3 0")]),
    ("afl", "academic free", [r"academic free license"], [("2.1", "2 1"), ("3.0", "3 0")]),
    ("artistic", "artistic", [r"artistic license"], [("1.0", "1 0"), ("2.0", "2(?: 0)?")]),
    ("bsl", "boost", [r"boost software license"], [("1.0", "1 0")]),
    ("gfdl", "free documentation", [r"gnu free documentation license", r"free documentation license"],
     [("1.1", "1 1"), ("1.2", "1 2"), ("1.3", "1 3")]),
    ("psf", "python software", [r"python software foundation license"], [("2", "2")]),
    ("zpl", "zope", [r"zope public license"], [("2.0", "2 0"), ("2.1", "2 1")]),
    ("ms-pl", "microsoft public", [r"microsoft public license"], []),
    ("ms-rl", "microsoft reciprocal", [r"microsoft reciprocal license"], []),
    ("odbl", "open database", [r"open database license"], [("1.0", "1 0")]),
    ("ofl", "open font", [r"sil open font license", r"open font license"], [("1.0", "1 0"), ("1.1", "1 1")]),
    ("mit", "mit licen", [r"mit license", r"the mit licence"], []),
    ("mit", "mit x11", [r"mit x11 license"], []),
    ("mit", "expat", [r"expat license"], []),
    ("bsd", "bsd", [r"bsd license", r"bsd style license"], []),
    ("bsd", "berkeley", [r"berkeley software distribution license"], []),
    ("bsd-2-clause", "bsd", [r"(?:2|two) clause bsd(?: license)?", r"bsd (?:2|two) clause(?: license)?",
                             r"simplified bsd license"], []),
    ("bsd-2-clause", "freebsd", [r"freebsd license"], []),
    ("bsd-3-clause", "bsd", [r"(?:3|three) clause bsd(?: license)?", r"bsd (?:3|three) clause(?: license)?",
                             r"new bsd license", r"modified bsd license"], []),
    ("isc", "isc license", [r"isc license"], []),
    ("zlib", "zlib", [r"zlib license", r"zlib libpng license"], []),
    ("unlicense", "unlicense", [r"the unlicense", r"unlicense org"], []),
    ("wtfpl", "wtfpl", [r"wtfpl"], []),
    ("cc0", "cc0", [r"cc0(?: 1 0)?(?: universal)?"], []),
    ("cc0", "creative commons", [r"creative commons zero"], []),
    ("public-domain", "public domain", [r"public domain", r"dedicated to the public domain"], []),
]

# Creative Commons: the conditions in order, the versions, the short and the long name.
CC_PARTS = [("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"),
            ("by-nd", "by nd", "attribution no ?deriv(?:s|atives)"),
            ("by-nc", "by nc", "attribution non ?commercial"),
            ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
            ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

# Notices and license sentences: label, keyword, regex, priority, confidence.
NOTICES = [
    ("copyright", "copyright", r"copyright(?: c| ©)?(?: [0-9]{4})+", 1, 0.4),
    ("copyright", "copyright", r"copyright (?:by|holders?|owners?|notice)", 1, 0.3),
    ("reserved", "rights reserved", r"all rights reserved", 2, 0.6),
    ("reserved", "rights reserved", r"(?:some|no) rights reserved", 2, 0.4),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 2, 0.7),
    ("proprietary", "reproduc", r"no part of this [a-z]+ may be reproduced", 2, 0.7),
    ("proprietary", "permission", r"without (?:the )?(?:prior |express )?(?:written )?permission", 2, 0.5),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 4, 0.99),
    ("mit", "noninfringement", r"fitness for a particular purpose and noninfringement", 3, 0.8),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 4, 0.97),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 4, 0.95),
    ("bsd-3-clause", "endorse", r"be used to endorse or promote products derived from this software", 4, 0.9),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty", 4, 0.85),
    ("warranty-disclaimer", "warrant", r"without warrant(?:y|ies) of any kind", 1, 0.4),
    ("warranty-disclaimer", "provided", r"provided (?:on an )?as is", 1, 0.3),
    ("gpl", "free software", r"this program is free software", 4, 0.95),
    ("gpl", "gnu org", r"gnu org licenses(?: gpl)?", 3, 0.8),
    ("apache-2.0", "apache org", r"www apache org licenses license 2 0", 4, 0.97),
    ("cc", "creativecommons", r"creativecommons org(?: licenses| publicdomain)?", 2, 0.6),
    ("cc", "creative commons", r"creative commons(?: license)?", 1, 0.5),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 4, 0.99),
    ("spdx", "spdx", r"spdx license identifier", 3, 0.9),
    ("cc-by", "cc by", r"cc by", 1, 0.5),
]


def rules() -> list[dict]:
    """All rules, in the order that breaks ties. Priority: a version behind an
    introducing phrase 6, a version 5, a phrase with the name 3, the name 2."""
    out = []
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            for v, pattern in versions:
                out.append((f"{label}-{v}", keyword, f"{INTRO} {name}{V}{pattern}", 6, 0.98))
                out.append((f"{label}-{v}", keyword, f"{name}{V}{pattern}", 5, 0.9))
                out.append((f"{label}-{v}+", keyword, f"{name}{V}{pattern} or (?:any )?later", 7, 0.95))
            out.append((label, keyword, f"{INTRO} {name}", 3, 0.85))
            out.append((label, keyword, name, 2, 0.6))
    for label, short, long in CC_PARTS:
        for v in CC_VERSIONS:
            out.append((f"cc-{label}-{v.replace(' ', '.')}", "cc by", f"cc {short} {v}", 6, 0.97))
            out.append((f"cc-{label}-{v.replace(' ', '.')}", "creative commons",
                        f"creative commons {long} {v}", 6, 0.97))
        out.append((f"cc-{label}", "cc by", f"cc {short}(?: license)?", 4, 0.8))
        out.append((f"cc-{label}", "creative commons", f"creative commons {long}", 4, 0.85))
    for label in ("apache-2.0", "mit", "gpl-3.0", "bsd-3-clause"):
        out.append((label, "spdx", f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}", 8, 0.99))
    out += NOTICES
    return [dict(rule=i, label=a, keyword=k, pattern=rf"(?<= ){p}(?= )", priority=q, confidence=c)
            for i, (a, k, p, q, c) in enumerate(out)]


def _phrase(p: str) -> str:
    return rf"(?<= ){p}(?= )"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


SPAN = "array<struct<s:int,e:int>>"
HELD = "array<struct<s:int,ne:int,np:int,r:int,l:string,c:double>>"


def _places(lengths: Column) -> Column:
    """(s, e) of every detection, from the lengths (b, f) of the text before each
    and of the detection itself. A fold that appends copies its array, so it runs
    over blocks of about the root of n lengths, and over the blocks."""
    size = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")),
        lambda j: F.slice(lengths, j * size + 1, size))
    begun = F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,z:array<struct<b:int,f:int>>>>").alias("out")),
        lambda a, z: F.struct(
            F.aggregate(z, a["at"], lambda n, x: n + x["b"] + x["f"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), z.alias("z")))).alias("out")),
        lambda a: a["out"])
    return F.flatten(F.transform(begun, lambda block: F.aggregate(
        block["z"], F.struct(block["at"].alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, z: F.struct((a["at"] + z["b"] + z["f"]).alias("at"),
                              F.when(z["f"] > 0, F.concat(a["out"], F.array(F.struct(
                                  (a["at"] + z["b"]).alias("s"), (a["at"] + z["b"] + z["f"]).alias("e")))))
                              .otherwise(a["out"]).alias("out")),
        lambda a: a["out"])))


def _spans(norm: Column, r: Column) -> Column:
    """The rule's detections in the normalised text, as (start, -end, -priority,
    rule, label, confidence): what may hold another one sorts before it."""
    found = F.regexp_extract_all(norm, r["pattern"], F.lit(0))
    between = F.split(norm, r["pattern"])
    # a detection starts behind all earlier pieces and detections
    lengths = F.transform(F.arrays_zip(between.alias("b"), found.alias("f")),
                          lambda z: F.struct(F.length(z["b"]).alias("b"),
                                             F.coalesce(F.length(z["f"]), F.lit(0)).alias("f")))
    return F.transform(_let(lengths, _places), lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("ne"), (-r["priority"]).alias("np"), r["rule"].alias("r"),
        r["label"].alias("l"), r["confidence"].alias("c")))


def _unsuppressed(spans: Column) -> Column:
    """(n, out): how many detections no other one suppresses, and their distinct
    (label, confidence). A detection is suppressed by one that holds its interval
    and has a higher priority, or the same and is longer, or as long and of an
    earlier rule. That order is transitive, so one sweep by start, longest first,
    needs only the unsuppressed ones that have not ended yet: at most one a rule,
    however many detections the text has."""
    def step(a, x):
        def decide(held):
            """The state, given whether x is suppressed."""
            live = F.filter(a["live"], lambda y: -y["ne"] > x["s"])
            return F.struct(
                F.when(held, live).otherwise(F.concat(live, F.array(F.struct(x["s"], x["ne"], x["np"], x["r"])))).alias("live"),
                F.when(held, a["out"]).otherwise(
                    F.array_union(a["out"], F.array(F.struct(x["l"].alias("l"), x["c"].alias("c"))))).alias("out"),
                (a["n"] + F.when(held, 0).otherwise(1)).alias("n"))
        wider = lambda y: (y["ne"] + y["s"]) < (x["ne"] + x["s"])
        return _let(F.exists(a["live"], lambda y: (y["ne"] <= x["ne"]) & (
            (y["np"] < x["np"]) | ((y["np"] == x["np"]) & (wider(y) | (y["s"] == x["s"]) & (y["ne"] == x["ne"]) & (y["r"] < x["r"]))))),
            decide)
    start = F.struct(F.array().cast("array<struct<s:int,ne:int,np:int,r:int>>").alias("live"),
                     F.array().cast("array<struct<l:string,c:double>>").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(spans), start, step, lambda a: F.struct(a["n"].alias("n"), a["out"].alias("out")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_detections."""
    table = rules()
    keywords = sorted({r["keyword"] for r in table} | {p for p, _ in BASE})
    # a keyword begins a word; its words may be apart by any run of non-word characters
    gate = f"(?i)(?<!{IN_WORD[:-1]})(?:" + "|".join(k.replace(" ", NOT_WORD) for k in keywords) + ")"
    literal = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in table])
    base_literal = F.array(*[F.lit(p) for p, _ in BASE])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
            .withColumn("norm", F.when(F.col("text").rlike(gate), F.concat(
                F.lit(" "), F.trim(F.translate(F.regexp_replace("text", NOT_WORD, " "), UPPER, LOWER)), F.lit(" "))))
            .withColumn("n_words", F.when(F.col("norm").isNotNull(), F.when(F.col("norm") == "  ", 0)
                                          .otherwise(_spaces(F.col("norm")) - 1))
                        .otherwise(F.regexp_count("text", F.lit(IN_WORD))).cast("long")))
    held = F.filter(literal, lambda r: F.col("norm").contains(r["keyword"]))
    spans = F.flatten(F.transform(held, lambda r: F.when(
        F.rlike(F.col("norm"), r["pattern"]), _spans(F.col("norm"), r)).otherwise(
            F.array().cast(HELD))))
    rows = rows.withColumn("kept", F.when(F.col("norm").isNotNull(), _unsuppressed(spans)))

    places, first, last, names = [], [], [], []
    for phrase, label in BASE:
        parts = F.split(F.col("norm"), _phrase(phrase), -1)
        n = F.when(F.col("norm").contains(f" {phrase} "), F.size(parts) - 1).otherwise(0)
        places.append(F.coalesce(n, F.lit(0)))
        first.append(F.when(n > 0, _spaces(F.element_at(parts, 1)) - 1))
        last.append(F.when(n > 0, F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        names.append(F.when(n > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")))
    base = F.array_sort(F.array_distinct(F.concat(*names)))
    found = F.coalesce(F.col("kept.out"), F.array().cast("array<struct<l:string,c:double>>"))
    mined = F.transform(found, lambda x: x["l"])
    doubt = F.aggregate(found, F.lit(1.0), lambda a, x: a * (1 - x["c"]))
    return rows.select(
        "doc_id", "n_words", sum(places[1:], places[0]).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, mined))), ",").alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
        F.coalesce(F.col("kept.n"), F.lit(0)).cast("long").alias("n_detections"))
