"""Queries over the contamination operators."""

from pyspark.sql import functions as F

from gavelflow.operators import decontam as D

from .base import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir, words=D.ws_words, n=8, whole=False, table="documents", key="doc_id"):
    return D.with_grams(_t(spark, sf_dir, table).select(key, "text", *(["source"] if table == "documents" else [])), words, n, whole)


def _reference(spark, sf_dir):
    return D.gram_table(_docs(spark, sf_dir, table="benchmark", key="item_id"), "item_id").select("gram").distinct()


WS = "list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda w: w <> '')"
ALNUM = "regexp_extract_all(lower(text), '[a-z0-9]+')"
PUNCT = r"""list_transform(list_filter(regexp_split_to_array(lower(text), '[ \n]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[.,;:!?"''()\[\]{}]+|[.,;:!?"''()\[\]{}]+$', '', 'g'))"""


def grams(table, key, words, n):
    return f"SELECT DISTINCT {key}, array_to_string(x[i : i + {n - 1}], ' ') AS gram FROM (SELECT {key}, {words} AS x FROM {table}) AS w, unnest(range(1, len(x) - {n - 2})) AS r(i)"


def counts(table, key, words, n):
    return f"SELECT t.{key}, count(gram) AS n FROM {table} t LEFT JOIN ({grams(table, key, words, n)}) g ON t.{key} = g.{key} GROUP BY t.{key}"


def _count(words, n=8, whole=False, table="documents", key="doc_id"):
    return lambda spark, sf: _docs(spark, sf, words, n, whole, table, key).select(key, F.size("grams").cast("long").alias("n"))


LEAK = f"SELECT DISTINCT doc_id FROM ({grams('documents', 'doc_id', WS, 8)}) g JOIN (SELECT DISTINCT gram FROM ({grams('benchmark', 'item_id', WS, 8)})) b ON g.gram = b.gram"
query("ngram8_ws", _count(D.ws_words), counts("documents", "doc_id", WS, 8))
query("ngram8_word", _count(D.word_words, table="benchmark", key="item_id"), counts("benchmark", "item_id", "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')", 8))
query("ngram8_punct", _count(D.punct_words), counts("documents", "doc_id", PUNCT, 8))
query("ngram_reference", lambda spark, sf: _reference(spark, sf), f"SELECT DISTINCT gram FROM ({grams('benchmark', 'item_id', WS, 8)})")
query("decontam_row", lambda spark, sf: D.decontaminate(_t(spark, sf, "documents"), "doc_id", _t(spark, sf, "benchmark"), D.ws_words, 8).select("doc_id", "source"), f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN ({LEAK})")
query("decontam_group", lambda spark, sf: D.decontaminate_groups(_t(spark, sf, "documents").withColumn("grp", F.floor(F.col("doc_id") / 4)), "doc_id", "grp", _t(spark, sf, "benchmark"), D.ws_words, 8).select("doc_id", "grp"), f"SELECT doc_id, CAST(floor(doc_id / 4) AS bigint) AS grp FROM documents WHERE CAST(floor(doc_id / 4) AS bigint) NOT IN (SELECT CAST(floor(doc_id / 4) AS bigint) FROM ({LEAK}))")
query("shingle5", _count(D.alnum_words, 5, True), f"SELECT doc_id, CASE WHEN len({ALNUM}) BETWEEN 1 AND 4 THEN 1 ELSE n END AS n FROM documents JOIN ({counts('documents', 'doc_id', ALNUM, 5)}) USING (doc_id)")


def _overlap(spark, sf):
    best = D.overlap(_t(spark, sf, "benchmark"), _t(spark, sf, "documents"), "item_id", "doc_id", D.alnum_words, 5)
    return best.withColumn("flagged", F.col("jaccard") >= 0.8).orderBy(F.desc("jaccard"), "item_id").limit(10)


def _sh(table, key):
    return f"{grams(table, key, ALNUM, 5)} UNION SELECT {key}, array_to_string({ALNUM}, ' ') AS gram FROM {table} WHERE len({ALNUM}) BETWEEN 1 AND 4"


query("overlap_topk", _overlap, f"""WITH q AS ({_sh('benchmark', 'item_id')}), s AS ({_sh('documents', 'doc_id')}), nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY ALL), ns AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
    h AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN s USING (gram) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS k FROM h)
    SELECT item_id, doc_id, shared, round(shared / (nq.n + ns.n - shared), 6) AS jaccard, round(shared / (nq.n + ns.n - shared), 6) >= 0.8 AS flagged FROM b JOIN nq USING (item_id) JOIN ns USING (doc_id) WHERE k = 1 ORDER BY jaccard DESC, item_id LIMIT 10""")
