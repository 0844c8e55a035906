"""Base columns against a word-by-word scan; suppression on hand-made texts."""

import random
import re
import time

from llm_data import by_id, docs, edge_rows, empty, lowered

from farelens.llm.license_scan import BASE, rules, scan_licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORDS.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_base_columns(spark):
    rng = random.Random(1)
    bits = ["CC", "by", "cc-BY", "general", "Public", "license", "all", "rights", "RESERVED", "é", "x9", "…", "under", "mit", "\n"]
    rows = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(bits, k=rng.randint(1, 40)))) for i in range(300)]
    rows += [(1000, "cc by cc by cc by"), (1001, "all rights\n\nreserved."), (1002, "CCBY"), (1003, "xcc by"), (1004, "cc byx")]
    got = by_id(scan_licenses(docs(spark, rows, clash=True)))
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_detections_and_suppression(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "GNU General Public License version 3 or any later version": "gpl,gpl-3.0+",
        "This file is CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "Creative Commons Attribution NonCommercial 3.0": "cc-by-nc-3.0",
        "two clause BSD license": "bsd-2-clause",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "nothing of this kind": "",
        "gplx lgplx": "",
    }
    got = by_id(scan_licenses(docs(spark, list(enumerate(texts)))))
    assert [got[i]["labels"] for i in range(len(texts))] == list(texts.values())
    assert got[0]["score"] == 0.98 and got[0]["n_detections"] == 1 and got[6]["score"] == 0


def test_rules_are_many_and_reachable(spark):
    table = rules()
    assert len(table) > 300
    # a rule's keyword occurs in whatever its regex matches: taken from the regex's own words
    for r in table:
        assert all(w in r["pattern"].replace("(?:", "").replace("?", "") for w in r["keyword"].split()), r


def test_edges(spark):
    out = scan_licenses(docs(spark, edge_rows(), clash=True)).collect()
    assert len(out) == len([i for i, _ in edge_rows() if i is not None])
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" for r in out)
    assert scan_licenses(empty(spark)).count() == 0


def sample(tree, full: bool) -> str:
    """A text of the regex: its first branches without or with what is optional."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, value = arg[0]
            out += chr(value if str(kind) == "LITERAL" else value[0])
        elif op == "MAX_REPEAT":
            out += sample(arg[2], full) * (max(1, arg[0]) if full else arg[0])
        elif op == "SUBPATTERN":
            out += sample(arg[3], full)
        elif op == "BRANCH":
            out += sample(arg[1][-1 if full else 0], full)
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op   # the blanks around
    return out


def test_every_rule_fires_alone(spark):
    table = rules()
    texts = [sample(re._parser.parse(r["pattern"]), full) for r in table for full in (False, True)]
    got = by_id(scan_licenses(docs(spark, list(enumerate(texts)))))
    silent = [t for i, t in enumerate(texts) if got[i]["n_detections"] == 0 or got[i]["score"] == 0]
    assert silent == []
    other = [(r["label"], t) for i, t in enumerate(texts) for r in [table[i // 2]]
             if r["label"] not in got[i]["labels"].split(",")
             # a rule of higher priority or earlier in the table may hold the same text
             and not any(x["label"] in got[i]["labels"].split(",") and re.search(x["pattern"], f" {t} ") for x in table)]
    assert other == []


def test_short_forms(spark):
    texts = {"FreeBSD License": "bsd-2-clause", "GPLv2": "gpl-2.0", "GPLv3": "gpl-3.0", "LGPLv2.1": "lgpl-2.1",
             "LGPLv2": "lgpl-2.0", "AGPLv3": "agpl-3.0", "GPL v2": "gpl-2.0", "GPLv3 or later": "gpl-3.0+",
             "gplvx gplv agplv23": ""}
    got = by_id(scan_licenses(docs(spark, list(enumerate(texts)))))
    assert [got[i]["labels"] for i in range(len(texts))] == list(texts.values())


def detected(text, table):
    """(labels, score, detections) by a search for every rule and a comparison of all pairs."""
    norm = " " + " ".join(WORDS.findall(lowered(text))) + " "
    spans = [(m.start(), m.end(), r) for r in table for m in re.finditer(r["pattern"], norm)]

    def inside(x, y):
        key = lambda z: (z[2]["priority"], z[1] - z[0], -z[2]["rule"])
        return y[0] <= x[0] and y[1] >= x[1] and key(y) > key(x)
    kept = [x for x in spans if not any(inside(x, y) for y in spans)]
    doubt = 1.0
    for _, c in {(r["label"], r["confidence"]) for _, _, r in kept}:
        doubt *= 1 - c
    return {r["label"] for _, _, r in kept}, doubt, len(kept)


def test_detections_equal_brute_force(spark):
    table = rules()
    rng = random.Random(4)
    samples = [sample(re._parser.parse(r["pattern"]), full) for r in table for full in (False, True)]
    glue = [" ", ", ", " or ", " and any later ", "\n", " licensed under the ", " version "]
    rows = []
    for i in range(120):
        rows.append((i, "".join(x for s in rng.choices(samples, k=rng.randint(1, 12)) for x in (s, rng.choice(glue)))))
    rows.append((500, ""))
    got = by_id(scan_licenses(docs(spark, rows)))
    for i, t in rows:
        labels, doubt, n = detected(t, table)
        r = got[i]
        assert r["n_detections"] == n, t
        assert set(filter(None, r["labels"].split(","))) == labels | set(filter(None, r["base_labels"].split(",")))
        assert abs(r["score"] - (1 - doubt)) < 1e-6


def test_thousands_of_mentions_in_one_text(spark):
    n = 20_000
    rows = [(1, "Licensed under the MIT License, GPLv3 or later and Apache License 2.0. " * n), (2, "GPLv3 " * n)]
    began = time.monotonic()
    got = by_id(scan_licenses(docs(spark, rows)))
    one = by_id(scan_licenses(docs(spark, [(1, rows[0][1][:len(rows[0][1]) // n])])))[1]
    assert got[1]["n_detections"] == n * one["n_detections"] and got[1]["labels"] == one["labels"]
    assert got[1]["score"] == one["score"] and got[2]["n_detections"] == n
    assert time.monotonic() - began < 90
