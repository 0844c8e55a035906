"""URL filtering: a fixed rule list first, mined association rules for the rest.

Rules (host, path) allow or block a host with all its subdomains where the
url's path starts with the rule's; the longest rule wins. The urls that a rule
judges are the labels: FP-growth mines the frequent combinations of url tokens
and verdict over all of them, and the association rules "tokens -> verdict"
that reach the support and the confidence remain. They are matched to the urls
without a rule by an inverted index from token to rule: urls are first reduced
to the frequent tokens they hold and equal sets are matched once, a rule fits
where all its tokens are found. Of the fitting rules the one with the highest
confidence, then support, then the most tokens, then "allow" decides; a url
that no mined rule fits is allowed.

Defined results: a null url or one without "://" has an empty host and path
and no rule; repeated rows are judged each; rows without a page_id are left
out; without any labelled url every verdict is "allow".
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import stage_table

# The rule list, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.6
VERDICT = "verdict="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url column; both empty without "://"."""
    rest = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; both null without one. The
    rules are tried from the longest to the shortest."""
    rule = verdict = None
    for v, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def url_tokens() -> Column:
    """The distinct tokens of a url: host labels, the last two and one label of
    the host, path words with digits folded, and query names."""
    labels = F.split("host", r"\.")
    words = F.split(F.regexp_replace(F.lower("path"), r"[0-9]+", "0"), r"[^a-z0\x{80}-\x{10FFFF}]+")
    names = F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    tagged = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.array(F.concat(F.lit("d1:"), F.substring_index("host", ".", -1)),
                F.concat(F.lit("d2:"), F.substring_index("host", ".", -2))),
        F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("q:"), x)))
    return F.array_distinct(tagged)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules (tokens, verdict, confidence, support) from all rows of
    (tokens, verdict). Only tokens that reach the support enter the mining, as
    no combination is more frequent than its parts; equal transactions stay
    apart, for support counts rows. Copied host labels (d1, d2 beside h) say the
    same twice, so the mined items leave h out where d1 or d2 has it."""
    n = labelled.count()
    if n == 0:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, "
                                                         "confidence double, support double")
    frequent = (labelled.select(F.explode("tokens").alias("t")).groupBy("t").count()
                .where(F.col("count") >= min_support * n))
    # at most (tokens of a url) / min_support tokens are frequent, however many urls there are
    items = stage_table(labelled.sparkSession, labelled.withColumn("id", F.monotonically_increasing_id()), "urls")
    kept = (items.select("id", F.explode("tokens").alias("t")).join(frequent, "t")
            .groupBy("id").agg(F.collect_set("t").alias("ts")))
    transactions = (items.join(kept.hint("merge"), "id", "left")
                    .select(F.concat(F.coalesce("ts", F.array().cast("array<string>")),
                                     F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(transactions)
    return (model.associationRules
            .where(F.element_at("consequent", 1).startswith(VERDICT)
                   & ~F.exists("antecedent", lambda x: x.startswith(VERDICT)))
            .select(F.array_sort("antecedent").alias("tokens"),
                    F.substring(F.element_at("consequent", 1), len(VERDICT) + 1, 99).alias("verdict"),
                    "confidence", "support"))


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_key, mined): the verdict of the best mined rule for each row of
    ``urls`` (page_key, tokens) that a rule fits."""
    rules = stage_table(rules.sparkSession, rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "rules")
    index = rules.select(F.explode("tokens").alias("t"), "rule_id", F.size("tokens").alias("needs"),
                         "verdict", "confidence", "support")
    known = index.select("t").distinct()
    reduced = (urls.select("page_key", F.explode("tokens").alias("t")).join(known, "t")
               .groupBy("page_key").agg(F.array_sort(F.collect_set("t")).alias("have")))
    sets = reduced.groupBy("have").agg(F.count("*").alias("n"))
    fits = (sets.select("have", F.explode("have").alias("t")).join(index, "t")
            .groupBy("have", "rule_id", "needs", "verdict", "confidence", "support").agg(F.count("*").alias("found"))
            .where("found = needs"))
    best = fits.groupBy("have").agg(F.max_by("verdict", F.struct(
        "confidence", "support", "needs", (F.col("verdict") == "allow").alias("a"), "rule_id")).alias("mined"))
    return reduced.hint("merge").join(best, "have").select("page_key", "mined")


def filter_urls(pages: DataFrame, min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per page: page_id, host, path, rule (null without one), verdict."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_columns()
    judged = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
              .where("page_id is not null").withColumn("host", F.coalesce(host, F.lit("")))
              .withColumn("path", F.coalesce(path, F.lit("")))
              .withColumn("rule", rule).withColumn("listed", verdict))
    judged = stage_table(spark, judged.withColumn("page_key", F.xxhash64("url", F.lit(5)))
                         .withColumn("tokens", url_tokens()).drop("url"), "judged")
    mined = mine(judged.where("rule is not null").select("tokens", F.col("listed").alias("verdict")),
                 min_support, min_confidence)
    # equal urls are matched once; their 64-bit key and host and path stand for the url
    open_urls = judged.where("rule is null").groupBy("page_key").agg(F.any_value("tokens").alias("tokens"))
    found = apply_rules(open_urls, mined)
    return (judged.join(found.hint("merge"), "page_key", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("listed", F.when(F.col("rule").isNull(), F.col("mined")), F.lit("allow"))
                    .alias("verdict")))
