"""Listed rules, and the mined ones against a count of all token sets."""

import itertools
import random

from pyspark.sql import functions as F

from farelens.llm import url_rules as U

URLS = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://WWW.Example.com/en/1?x=/fr/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
    ("http://example.com", "example.com", "", None, None),
    ("http://com/", "com", "/", "com/", "allow"),
    ("http://notcom/es/", "notcom", "/es/", None, None),
    ("http://a.net/es/#x", "a.net", "/es/", "net/es/", "block"),
    ("http://a.net/fr/q?z#y", "a.net", "/fr/q", "net/fr/", "block"),
    ("http://a.net/de/", "a.net", "/de/", None, None),
    ("ftp://h?p=://q/es/", "h", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://", "", "", None, None),
    ("http://É.COM/x", "É.com", "/x", "com/", "allow"),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")


def test_listed_rules(spark):
    df = pages(spark, [u for u, *_ in URLS]).withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = {r["page_id"]: r for r in U.filter_urls(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), URLS[i]
        assert got[i]["verdict"] == verdict or (verdict is None and got[i]["verdict"] in ("allow", "block"))


def test_mined_rules_are_the_confident_frequent_ones(spark):
    rng = random.Random(2)
    rows = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.choice(["allow", "block", "block"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r["tokens"]), r["verdict"]): (round(r["confidence"], 9), round(r["support"], 9))
           for r in U.mine(df, 0.05, 0.7).collect()}
    want = {}
    for n in range(1, 5):
        for s in itertools.combinations("abcdef", n):
            holds = [v for t, v in rows if set(s) <= set(t)]
            for v in ("allow", "block"):
                k = holds.count(v)
                if k >= 0.05 * len(rows) and k >= 0.7 * len(holds):
                    want[s, v] = (round(k / len(holds), 9), round(k / len(rows), 9))
    assert got == want and got


def test_rules_apply_by_confidence(spark):
    rules = spark.createDataFrame([(["a"], "block", 0.8, 0.5), (["a", "b"], "allow", 0.9, 0.1), (["c"], "block", 0.7, 0.1)],
                                  "tokens array<string>, verdict string, confidence double, support double")
    urls = spark.createDataFrame([(1, ["a"]), (2, ["b", "a", "z"]), (3, ["b"]), (4, ["c", "b"]), (5, [])],
                                 "page_key long, tokens array<string>")
    assert {r["page_key"]: r["mined"] for r in U.apply_rules(urls, rules).collect()} == {1: "block", 2: "allow", 4: "block"}


def test_verdicts_follow_the_labels(spark):
    urls = [f"http://h{i}.net/{('es', 'fr')[i % 2]}/{i}" for i in range(40)] + [f"http://h{i}.com/de/{i}" for i in range(40)] \
        + [f"http://o{i}.org/es/{i}" for i in range(5)] + [f"http://o{i}.org/de/{i}" for i in range(5)] * 2
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    assert all(got[i] == "block" for i in range(80, 85)) and all(got[i] == "allow" for i in range(85, 95))


def test_no_labels_and_no_rows(spark):
    assert [r["verdict"] for r in U.filter_urls(pages(spark, ["http://a.org/x"] * 3)).collect()] == ["allow"] * 3
    assert U.filter_urls(pages(spark, []).where("page_id is null")).count() == 0
