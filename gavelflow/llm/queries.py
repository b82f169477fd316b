"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .lm_score import lm_scores
from .near_dedup import classes
from .packing import pack
from .substring_dedup import substring_dedup
from . import line_dedup, mixing, toxicity
from .ann import search

#: White space and word patterns of the contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage_words=line_dedup.PASSAGE_WORDS)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows.where("vec_id % 20 = 0"), rows)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_near_dedup": op4_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_lm_score": op7_lm_score,
    "op8_line_dedup": op8_line_dedup,
    "op9_nearest": op9_nearest,
    "op10_pack": op10_pack,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, count(*) AS group_size FROM d GROUP BY ALL),
        k AS (SELECT text_sha256, doc_id AS keep_id FROM (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS n FROM d) WHERE n = 1)
        SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM k.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256) JOIN k USING (text_sha256)
    """,
    "op8_line_dedup": rf"""
        WITH l AS (SELECT doc_id, i - 1 AS i, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS r(i)),
        p AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
        f AS (SELECT *, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS n FROM p WHERE next IS NOT NULL),
        w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM l WHERE len(regexp_extract_all(line, '{WORD}')) > 50),
        g AS (SELECT DISTINCT doc_id, i + k AS i FROM f, (VALUES (0), (1)) AS v(k) WHERE n > 1 UNION SELECT doc_id, i FROM w WHERE n > 1),
        m AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i),
        r AS (SELECT doc_id, count(*) AS size FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m WHERE gone) GROUP BY doc_id, island),
        s AS (SELECT doc_id, count(*) AS n_runs, max(size) AS longest_run FROM r GROUP BY doc_id)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, coalesce(any_value(n_runs), 0) AS n_runs, coalesce(any_value(longest_run), 0) AS longest_run,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m LEFT JOIN s USING (doc_id) GROUP BY doc_id
    """,
    "op7_lm_score": rf"""
        WITH w AS (SELECT doc_id, i, x[i] AS w, CASE WHEN i > 1 THEN x[i - 1] END AS v, CASE WHEN i > 2 THEN x[i - 2] END AS u
                   FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS x FROM documents), unnest(range(1, len(x) + 1)) AS r(i)),
        c1 AS (SELECT w, count(*) AS n FROM w GROUP BY ALL), c2 AS (SELECT v, w, count(*) AS n FROM w WHERE v IS NOT NULL GROUP BY ALL), c3 AS (SELECT u, v, w, count(*) AS n FROM w WHERE u IS NOT NULL GROUP BY ALL),
        j AS (SELECT t.doc_id, c1.n AS n1, p.n AS p1, c2.n AS n2, q.n AS p2, c3.n AS n3, (SELECT count(*) FROM w) AS total
              FROM w AS t JOIN c1 ON t.w = c1.w LEFT JOIN c1 AS p ON t.v = p.w LEFT JOIN c2 ON t.v = c2.v AND t.w = c2.w LEFT JOIN c2 AS q ON t.u = q.v AND t.v = q.w LEFT JOIN c3 ON t.u = c3.u AND t.v = c3.v AND t.w = c3.w),
        s1 AS (SELECT *, log10(n1 / total) AS a FROM j),
        s2 AS (SELECT *, CASE WHEN n2 IS NULL THEN a WHEN n2 >= 2 THEN log10(n2 / p1) ELSE log10(0.4) + a END AS b FROM s1),
        s3 AS (SELECT doc_id, CASE WHEN n3 IS NULL THEN b WHEN n3 >= 2 THEN log10(n3 / p2) ELSE log10(0.4) + b END AS c, CASE WHEN n3 IS NOT NULL THEN n3 < 2 WHEN n2 IS NOT NULL THEN n2 < 2 ELSE false END AS backed FROM s2)
        SELECT d.doc_id, count(c) AS n_words, count(*) FILTER (backed) AS n_backoff, round(coalesce(sum(c), 0), 6) AS log10_score, round(coalesce(avg(c), 0), 6) AS score
        FROM documents AS d LEFT JOIN s3 ON d.doc_id = s3.doc_id GROUP BY d.doc_id
    """,
    "op1_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS x FROM documents),
        w AS (SELECT doc_id, i, array_to_string(x[i : i + 12], ' ') AS g FROM d, unnest(range(1, len(x) - 11)) AS r(i)),
        f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM w JOIN f USING (g), unnest(range(0, 13)) AS o(k) WHERE first < doc_id),
        a AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT doc_id, len(x) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(x, lambda v, i: NOT coalesce(list_contains(gone, i), false)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN a USING (doc_id)
    """,
}
