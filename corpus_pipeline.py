"""The corpus pipeline: five stages from raw documents to a source mix.

Each stage takes (spark, docs, sf_dir), works on every document that the one
before kept, and is written as Parquet before the next one reads it. All but
the last return the columns of ``documents``.

1. quality: documents below the classifier's threshold go.
2. near_duplicates: of each component of documents with five-word shingle
   similarity 0.8 or more, the one with the smallest doc_id stays.
3. repeated_passages: byte strings of 100 that start earlier as well are cut.
4. decontamination: documents that cover a benchmark item to a half go.
5. source_mix: what the mix takes of each source; documents of which it takes
   nothing go. ``taken`` says how many words it takes, repeats counted.

Defined results: a null text is empty; empty texts and texts of white space are
judged by the classifier like others, link with nothing, and the mix takes nothing
of them; of rows that repeat a doc_id the one with the smallest (text, source, lang,
n_chars), nulls first, goes on from stage 2; a row without a doc_id is kept by stage 2
and left out by the stages that report by id; empty tables give empty results; very
long texts are read whole; other columns than those of ``documents`` don't reach the
result, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm.common import stage_table, without_ids
from farelens.llm.decontamination import contamination
from farelens.llm.jaccard_join import jaccard_components
from farelens.llm.mixing import mix_sources
from farelens.llm.quality import keep_good
from farelens.llm.suffix_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id are rare; only then is one of them chosen, in
    the order above. Each task keeps one row of an id before any is shuffled."""
    ids = docs.where("doc_id is not null")
    if not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars"))
    return ids.withColumn("_nth", first).where("_nth = 1").drop("_nth").union(docs.where("doc_id is null"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = one_row_per_id(docs)
    groups = stage_table(spark, jaccard_components(docs, width=5, percent=80), "groups")
    return without_ids(docs, groups.where("doc_id <> component_id").select("doc_id").distinct())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, stage_table(spark, found.where("contaminated").select("doc_id").distinct(), "found"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    mix = mix_sources(docs).where("taken > 0").select("doc_id", "size", "source_size", "target", "taken")
    return docs.join(mix, "doc_id").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("source_mix", source_mix)]

# The classifier, the shingle joins and the tiling can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
