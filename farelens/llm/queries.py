"""The registered queries of this package and their SQL.

Each ``opN_<name>`` reads its whole table below ``sf_dir`` and returns the
operator's full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm.decontamination import contamination
from farelens.llm.fill_middle import fill_in_middle, restore
from farelens.llm.filter_audit import filter_interactions
from farelens.llm.fingerprints import fingerprint_edits
from farelens.llm.jaccard_join import jaccard_components
from farelens.llm.language_model import score_documents
from farelens.llm.license_scan import scan_licenses
from farelens.llm.mixing import mix_sources
from farelens.llm.quality import score_quality
from farelens.llm.suffix_dedup import remove_repeats
from farelens.llm.token_counts import token_counts
from farelens.llm.topk_search import exact_top_k
from farelens.llm.url_rules import filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_decontamination, op2_suffix_dedup, op3_jaccard_join, op4_license_scan, op5_url_filter, op6_language_model, op7_quality, op8_fingerprints, op9_source_mix, op10_token_counts,
    op11_fill_middle, op12_filter_audit, op13_topk_search,
)}

# A-Z in lower case, other letters as they are.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    # every 100-byte window, numbered within its equals; taken from pieces of 500 starts, as a
    # substring costs its distance from the start
    "op2_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x,
                          octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        piece AS (SELECT doc_id, n, k, substring(x, 1000 * k + 1, 1198) AS y FROM h, unnest(range(0, n // 500 + 1)) AS t(k)
                  WHERE n >= 100),
        w AS (SELECT doc_id, 500 * k + j AS p,
                     row_number() OVER (PARTITION BY substring(y, 2 * j + 1, 200) ORDER BY doc_id, 500 * k + j) AS nth
              FROM piece, unnest(range(0, least(500, n - 99 - 500 * k))) AS t(j)),
        d AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new
              FROM w WHERE nth > 1),
        g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM d),
        spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
        cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS last,
                       string_agg(substring(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS pieces
                FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
        SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(pieces, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM h LEFT JOIN cut USING (doc_id)""",
    # all pairs that share a shingle, and the closure of the links
    "op3_jaccard_join": f"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws
                             FROM documents WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ')
                              ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
              FROM t, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS u(i) WHERE len(ws) > 0),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
              GROUP BY ALL),
        l AS (SELECT x, y, m = cx.n AND m = cy.n AS same FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y
              WHERE 100 * m >= 90 * (cx.n + cy.n - m)),
        two AS (SELECT x, y, same FROM l UNION ALL SELECT y, x, same FROM l),
        r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, two.y FROM r JOIN two ON two.x = r.z),
        k AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id),
        e AS (SELECT x AS doc_id, count(*) AS copies FROM two WHERE same GROUP BY x)
        SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, k.component_id,
               CAST(coalesce(e.copies, 0) + 1 AS BIGINT) AS n_copies
        FROM documents d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "op11_fill_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
                          sha256('7:' || doc_id) AS h FROM documents),
        c AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                     ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
        s AS (SELECT *, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100
                             THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                     array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
                     array_to_string(u[greatest(a, b) + 1:], '') AS r FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || r || '<M>' || m
                      ELSE '<S>' || r || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(x) AS restored_sha256
        FROM s""",
    "op12_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
                          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     MAP {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
                          'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
                          'E': doc_id > min(doc_id) OVER (PARTITION BY t)} AS m
              FROM d LEFT JOIN l USING (doc_id)),
        x AS (SELECT part, good, toxic, concat(CASE WHEN m['A'] THEN 'A' END, CASE WHEN m['B'] THEN 'B' END,
                     CASE WHEN m['C'] THEN 'C' END, CASE WHEN m['D'] THEN 'D' END, CASE WHEN m['E'] THEN 'E' END) AS fails FROM f),
        cell AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letter a, letter b, letter c, letter d, letter e
                   WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        steps AS (SELECT o, k AS step, o[k] AS f, o[1:k - 1] AS before FROM orders, range(1, 6) AS r(k)),
        each AS (SELECT part, o, step, f, n, good, toxic, contains(fails, f) AS now, fails = f AS alone,
                        translate(fails, before, '') <> fails AND before <> '' AS gone FROM cell, steps),
        sums AS (SELECT part, o, step, f, sum(CASE WHEN NOT gone AND NOT now THEN n ELSE 0 END) AS kept,
                        sum(CASE WHEN NOT gone AND now THEN n ELSE 0 END) AS removed,
                        sum(CASE WHEN gone AND now THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
                        sum(CASE WHEN NOT gone AND now THEN good ELSE 0 END) AS good_lost,
                        sum(CASE WHEN NOT gone AND now THEN toxic ELSE 0 END) AS toxic_lost
                 FROM each GROUP BY ALL)
        SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM sums""",
    "op13_topk_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20""",
}
