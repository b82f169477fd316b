"""Normalisation, filters, keys, dedup and contamination on the pair relation."""

from pyspark.sql import functions as F

from gavelflow.operators import clean as C
from gavelflow.sources.readers import resolve_columns

from .base import DUCK, SPARK, expand, query, spark_sql, sql

#: Label vocabularies.
LABELS = "CASE lower(trim({0})) WHEN 'contradiction' THEN 0 WHEN 'refutes' THEN 0 WHEN '0' THEN 0 WHEN 'entailment' THEN 1 WHEN 'supports' THEN 1 WHEN '1' THEN 1 WHEN 'neutral' THEN 2 WHEN 'not enough info' THEN 2 WHEN '2' THEN 2 END"
RAW = "(VALUES ('a', 'Entailment'), ('b', ' neutral '), ('c', '0'), ('d', 'REFUTES'), ('e', 'unknown'), ('f', NULL)) AS raw(id, label)"
DECISIONS = """(VALUES ('q1', 'Which is a fruit?', 'apple|stone|car', 0), ('q2', 'Pick the colour', 'red|red|tree', 0), ('q3', 'Largest?', 'one|nine|five|two', 1), ('q4', 'Broken', 'x|y', 5)) AS decisions(id, question, opts, gold)"""


def norm(d, x):
    return f"trim({d.rx(f'lower({x})', '[ \\n]+', ' ')})"


def words(d, x):
    """Words of a text between blanks and line ends, without empty ones at the ends."""
    return d.split(f"trim({d.rx(x, '[ \\n]+', ' ')})", " ")


# projection and filters
sql("parse_label", lambda d: f"SELECT id, {LABELS.format('label')} AS label FROM {RAW}")
sql("native_label_remap", lambda d: "SELECT vec_id AS id, CASE label WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS label FROM embeddings WHERE label BETWEEN 0 AND 2")
sql("norm_label_by_name", lambda d: f"SELECT id, {LABELS.format('label')} AS label, CASE WHEN {LABELS.format('label')} IS NULL THEN 'unknown label' END AS reason FROM {RAW}")
sql("normalize_records", lambda d: "SELECT id, trim(premise) AS premise, trim(hypothesis) AS hypothesis, label, source FROM pair WHERE length(trim(premise)) > 0 AND length(trim(hypothesis)) > 0")
sql("xnli_row", lambda d: f"SELECT id, premise, hypothesis, label, language, {d.size(words(d, 'premise'))} + {d.size(words(d, 'hypothesis'))} AS length FROM pair WHERE premise <> '' AND hypothesis <> ''")
sql("swap_columns", lambda d: "SELECT id, hypothesis AS premise, premise AS hypothesis FROM pair")
sql("word_length", lambda d: f"SELECT id, CASE WHEN trim(premise) = '' THEN 0 ELSE {d.size(words(d, 'premise'))} END + CASE WHEN trim(hypothesis) = '' THEN 0 ELSE {d.size(words(d, 'hypothesis'))} END AS n FROM pair")
sql("whitespace_norm", lambda d: f"SELECT id, {norm(d, 'hypothesis')} AS text FROM pair")
sql("source_filter", lambda d: "SELECT id, source FROM pair WHERE source IN ('src1', 'src2') OR NOT EXISTS (SELECT 1 FROM pair WHERE source IN ('src1', 'src2'))")
sql("source_prefix_filter", lambda d: "SELECT id, source FROM pair WHERE source LIKE 'src1%' OR source LIKE 'src3%'")
ROUTE = "CASE WHEN source IN ('src0', 'src1') THEN 'trivial' WHEN source IN ('src2', 'src3', 'src4') THEN 'r1' WHEN source IN ('src5', 'src6') THEN 'medium' WHEN source IN ('src7', 'src8') THEN 'deep' WHEN source = 'src9' THEN 'hard' WHEN source = 'src10' THEN 'multimodal' ELSE 'unmapped' END"
sql("bucket_route", lambda d: f"SELECT {ROUTE} AS bucket, count(*) AS n FROM pair GROUP BY 1")
sql("drop_rule", lambda d: "SELECT id FROM pair WHERE NOT (coalesce(source, '') = 'src3' AND coalesce(label, -1) = 0)")
sql("banned_split", lambda d: "SELECT u.repo, u.split, b.repo IS NOT NULL AS banned FROM (VALUES ('x', 'test'), ('x', 'train'), ('y', 'any'), ('z', 'train')) AS u(repo, split) LEFT JOIN (VALUES ('x', 'test'), ('y', '*')) AS b(repo, split) ON u.repo = b.repo AND (b.split = '*' OR u.split = b.split)")
sql("review_filter", lambda d: "SELECT sample FROM verdict WHERE NOT coalesce(status <> 'ok', false)")
sql("image_path_rewrite", lambda d: f"SELECT page_id, concat('images/', {d.rx('p', '^.*images/', '')}) AS path FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat(page_id, '.png') WHEN 1 THEN concat('/data/images/', page_id, '.png') ELSE concat(url, '/images/y/images/', page_id, '.png') END AS p FROM pages) AS t")
sql("text_only_filter", lambda d: "SELECT page_id FROM pages WHERE html NOT LIKE '%<img%'")
#: The prompt boundaries that a text must not contain as such.
sql("sanitize_delims", lambda d: "SELECT doc_id, replace(replace(replace(text, concat(chr(10), 'Prediction:'), concat(chr(10), ' Prediction:')), 'Reference answer:', concat('Reference answer', chr(92), ':')), 'Candidate answer:', concat('Candidate answer', chr(92), ':')) AS x FROM (SELECT doc_id, concat(text, chr(10), 'Prediction: 1 Reference answer: 2 Candidate answer: 3') AS text FROM documents) AS t")
sql("dup_texts", lambda d: f"SELECT id, v AS text FROM {DECISIONS} {d.explode(d.split('opts', '[|]'))} GROUP BY id, v HAVING count(*) > 1")
sql("length_predicate", lambda d: "SELECT id FROM pair WHERE length(premise) >= 50 AND lower(hypothesis) LIKE '%license%'")
query("detect_columns", lambda spark, sf: resolve_columns(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("Context"), F.col("source").alias("CLAIM"), F.col("n_chars").alias("Label"), "doc_id")), "SELECT text AS premise, source AS hypothesis, n_chars AS label, doc_id FROM documents")

# keys
KEYS = {
    "key_norm_sha1": lambda d: f"sha1(concat({norm(d, 'premise')}, chr(31), {norm(d, 'hypothesis')}))",
    "key_norm_image": lambda d: f"sha1(concat({norm(d, 'premise')}, chr(31), {norm(d, 'hypothesis')}, chr(31), coalesce(source, '')))",
    "key_strip_tuple": lambda d: "concat(trim(premise), chr(31), trim(hypothesis))",
    "key_prefix512": lambda d: "lower(concat(substr(trim(premise), 1, 512), '||', substr(trim(hypothesis), 1, 512)))",
    "key_raw_sha256": lambda d: d.sha256("concat(premise, chr(0), hypothesis)"),
    "key_prefix200": lambda d: "concat(substr(lower(trim(premise)), 1, 200), chr(31), substr(lower(trim(hypothesis)), 1, 200))",
    "key_lower_bar": lambda d: "concat(lower(trim(coalesce(nullif(premise, ''), source))), ' ||| ', lower(trim(coalesce(nullif(hypothesis, ''), language))))",
    "key_field_sha": lambda d: f"concat({d.sha256('premise')}, ':', {d.sha256('hypothesis')})",
    "content_id": lambda d: f"concat('decision_', substr(sha1({d.object(hypothesis='hypothesis', premise='premise')}), 1, 10))",
    "template_signature": lambda d: f"coalesce(nullif(substr({norm(d, 'hypothesis')}, 1, 100), ''), nullif(substr({norm(d, 'premise')}, 1, 100), ''), '<none>')",
}
for _name, _key in KEYS.items():
    sql(_name, lambda d, k=_key: f"SELECT id, {k(d)} AS key FROM pair")
MD5_MOD = " + ".join(f"(ascii(substr(m, {i}, 1)) - CASE WHEN substr(m, {i}, 1) >= 'a' THEN 87 ELSE 48 END) * {pow(16, 32 - i, 10)}" for i in range(1, 33))
sql("hash_holdout", lambda d: f"SELECT id, ({MD5_MOD}) % 10 = 0 AS held_out FROM (SELECT id, md5({KEYS['key_norm_sha1'](d)}) AS m FROM pair) AS k")
# two levels, so that no task holds the whole table: digests of thousands of rows, then a digest of these
sql("resume_fingerprint", lambda d: f"SELECT substr({d.sha256(d.collect('part', 'bucket'))}, 1, 16) AS fingerprint FROM (SELECT CAST(floor(id / 1000) AS bigint) AS bucket, {d.sha256(d.collect('concat(id, label)', 'id'))} AS part FROM pair GROUP BY 1) AS b")

# dedup
sql("dedupe_first", lambda d: f"SELECT id, source FROM {d.earliest('pair', 'lower(premise), lower(hypothesis)', 'ord')} AS f")


def _pairs(spark, sf, where):
    return spark_sql(spark, sf, expand(f"SELECT id, premise, hypothesis, source, ord FROM pair WHERE {where}", SPARK))


# a train and a validation part, with the source in place of a picture
query(
    "dedupe_split", lambda spark, sf: C.dedupe_split(_pairs(spark, sf, "id % 10 <> 3"), _pairs(spark, sf, "id % 10 = 3"), "ord", C.pair_key(image="source")).groupBy("part").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped")),
    expand(f"""WITH k AS (SELECT ord, CASE WHEN id % 10 = 3 THEN 'val' ELSE 'train' END AS part, {KEYS['key_norm_sha1'](DUCK)} || chr(31) || source AS key FROM pair), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, ord) AS n FROM k)
    SELECT part, count(*) FILTER (n = 1) AS kept, count(*) FILTER (n > 1) AS dropped FROM f GROUP BY part""", DUCK),
)
query(
    "stage2_clean", lambda spark, sf: C.clean_stage(_pairs(spark, sf, "id % 10 NOT IN (3, 4)"), _pairs(spark, sf, "id % 10 = 4"), _pairs(spark, sf, "id % 10 = 3"), "ord", "src5").groupBy("part", "outcome").agg(F.count(F.lit(1)).alias("n")),
    expand("""WITH k AS (SELECT ord, source, trim(premise) AS p, trim(hypothesis) AS h, CASE id % 10 WHEN 3 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS part FROM pair),
    r AS (SELECT *, EXISTS (SELECT 1 FROM k t WHERE t.part = 'test' AND t.p = k.p AND t.h = k.h) OR (source <> 'src5' AND EXISTS (SELECT 1 FROM k t WHERE t.part = 'test' AND t.p = k.p)) AS over FROM k WHERE part <> 'test'),
    s AS (SELECT *, row_number() OVER (PARTITION BY part, over, p, h ORDER BY ord) AS n FROM r)
    SELECT part, CASE WHEN over THEN 'test overlap' WHEN part = 'val' AND EXISTS (SELECT 1 FROM r t WHERE t.part = 'train' AND NOT t.over AND t.p = s.p AND t.h = s.h) THEN 'train overlap' WHEN n > 1 THEN 'internal duplicate' ELSE 'kept' END AS outcome, count(*) AS n FROM s GROUP BY 1, 2""", DUCK),
)
sql("forbidden_antijoin", lambda d: f"WITH k AS (SELECT *, {KEYS['key_prefix512'](d)} AS key FROM pair) SELECT id FROM k WHERE id % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM k f WHERE f.id % 10 = 3 AND f.key = k.key)")
sql("avoid_prior", lambda d: "SELECT p.id FROM pair p WHERE p.source <> 'src2' OR NOT EXISTS (SELECT 1 FROM pair q WHERE q.source = 'src3' AND q.premise = p.premise)")
sql("arm_synth_filter", lambda d: f"WITH s AS (SELECT * FROM {d.earliest('(SELECT * FROM pair WHERE id % 4 = 0)', 'premise, hypothesis', 'ord')} AS f) SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.id % 4 <> 0 AND p.premise = s.premise AND p.hypothesis = s.hypothesis)")
sql("fresh_filter", lambda d: "SELECT p.id FROM pair p WHERE p.id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM pair q WHERE q.id % 4 = 2 AND q.premise = p.premise) AND NOT EXISTS (SELECT 1 FROM pair q WHERE q.id % 4 = 3 AND q.premise = p.premise)")
sql("exact_overlap_audit", lambda d: f"SELECT count(*) AS shared, count(*) > 0 AS failed FROM (SELECT {d.sha256('premise')} AS k FROM pair WHERE id % 2 = 0 INTERSECT SELECT {d.sha256('premise')} AS k FROM pair WHERE id % 2 = 1) AS x")
sql("author_novelty", lambda d: "SELECT CAST(floor(id / 100) AS bigint) AS batch, count(*) AS accepted, round(count(DISTINCT premise) / count(*), 6) AS uniqueness FROM pair p WHERE NOT EXISTS (SELECT 1 FROM pair q WHERE q.ord < p.ord AND q.premise = p.premise) GROUP BY 1")
sql("eval_exclusion", lambda d: "SELECT b.item_id, EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) AS excluded FROM benchmark b")
sql("template_cap", lambda d: f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {KEYS['template_signature'](d)} ORDER BY ord) AS n FROM pair) AS t WHERE n <= 2")

# sets
sql("set_union", lambda d: "SELECT premise FROM pair WHERE id % 3 = 0 UNION SELECT premise FROM pair WHERE id % 3 = 1")
sql("set_intersect", lambda d: "SELECT premise FROM pair WHERE id % 3 = 0 INTERSECT SELECT premise FROM pair WHERE id % 3 = 1")
sql("set_except", lambda d: "SELECT premise FROM pair WHERE id % 3 = 0 EXCEPT SELECT premise FROM pair WHERE id % 3 = 1")
sql("bag_union", lambda d: "SELECT id, source FROM pair WHERE id % 3 = 0 UNION ALL SELECT id, source FROM pair WHERE id % 2 = 0")
