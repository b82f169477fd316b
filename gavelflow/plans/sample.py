"""Sampling, balancing, splitting, mixing, and ranking with caps. Every seeded draw is an order by md5(seed:key).

Ranks over whole tables are fixtures of window functions for the oracle; Spark
gets them from the two-level operator of the same meaning.
"""

from pyspark.sql import functions as F

from gavelflow.operators import sample as S
from gavelflow.operators.ranks import by_hash, ranked

from .base import DUCK, FIXTURES, OPERATORS, SPARK, expand, query, rank_relation, spark_sql, sql

H = lambda k, seed=42: f"md5(concat('{seed}:', {k}))"

#: Pairs with their place by hash among all (ra of n) and in their label (rl of nl).
FIXTURES["ranked_pairs"] = lambda d: f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H('id')}) AS rl, row_number() OVER (ORDER BY {H('id')}) AS ra, count(*) OVER (PARTITION BY label) AS nl, count(*) OVER () AS n FROM pair"


def _pairs(spark, sf):
    d = spark_sql(spark, sf, expand(f"SELECT *, {H('id')} AS h FROM pair", SPARK))
    d = ranked(d, by_hash("h"), ["h"], rank="ra", size="n")
    return ranked(d, by_hash("h"), ["h"], by=["label"], rank="rl", size="nl").drop("h")


OPERATORS["ranked_pairs"] = _pairs
rank_relation("ranked_groups", lambda d: f"SELECT group_id, count(*) AS size, {H('group_id')} AS h FROM grouped GROUP BY group_id", "h, group_id", before="before", adds="size", total="total")
rank_relation("ranked_premises", lambda d: f"SELECT premise, count(*) AS size, {H('premise')} AS h FROM pair WHERE id % 2 = 0 GROUP BY premise", "h, premise", before="before", adds="size", total="total")
rank_relation("ranked_frac", lambda d: f"SELECT id, source = 'src0' AS part, {H('id')} AS h FROM pair", "h", by="part")
rank_relation("ranked_dose", lambda d: f"SELECT id, id % 4 = 0 AS part, {H('id')} AS h FROM pair", "h", by="part")
BAND = "CASE WHEN length(hypothesis) < 500 THEN 'trivial' WHEN length(hypothesis) < 2000 THEN 'medium' ELSE 'hard' END"
rank_relation("ranked_bands", lambda d: f"SELECT id, {BAND} AS band, {H('id')} AS h FROM pair", "h", by="band")
rank_relation("ranked_strata", lambda d: f"""SELECT grp, stratum, {H('grp')} AS h FROM (SELECT grp, label AS stratum, row_number() OVER (PARTITION BY grp ORDER BY size DESC, first) AS top
    FROM (SELECT CAST(floor(id / 4) AS bigint) AS grp, label, count(*) AS size, min(ord) AS first FROM pair GROUP BY 1, 2) AS c) AS m WHERE top = 1""", "h", by="stratum")


def _of(spark, sf, body):
    return spark_sql(spark, sf, expand(body, SPARK))


sql("seeded_shuffle", lambda d: f"SELECT id, ra AS position FROM ranked_pairs")
query("seeded_sample_n", lambda spark, sf: S.take(_of(spark, sf, "SELECT id, label, source, ord FROM pair"), "id", 100).select("id"), expand((lambda d: "SELECT id FROM ranked_pairs WHERE ra <= 100")(DUCK), DUCK))
query("seeded_slice", lambda spark, sf: S.take(_of(spark, sf, "SELECT id, label, source, ord FROM pair"), "id", 50, 7).select("id"), expand((lambda d: f"SELECT id FROM pair ORDER BY {H('id', 7)}, id LIMIT 50")(DUCK), DUCK))
query("take_cases", lambda spark, sf: S.take(_of(spark, sf, "SELECT id, label, source, ord FROM pair"), "id", 100).select("id", "ord").orderBy("ord"), expand((lambda d: "SELECT id, ord FROM ranked_pairs WHERE ra <= 100 ORDER BY ord")(DUCK), DUCK))
query("balanced_111", lambda spark, sf: S.balanced(_of(spark, sf, "SELECT id, label, source, ord FROM pair"), "label", "id", 90).select("id", "label"), expand((lambda d: f"SELECT id, label FROM ranked_pairs WHERE rl <= floor(90 / 3)")(DUCK), DUCK))
sql("balanced_fill", lambda d: "SELECT id, label FROM ranked_pairs ORDER BY CASE WHEN rl <= floor(100 / 3) + 1 THEN 0 ELSE 1 END, ra LIMIT 100")
sql("class_cap_ratio", lambda d: f"SELECT id, label FROM ranked_pairs WHERE label <> 0 OR rl <= floor(0.45e0 / (1 - 0.45e0) * (n - nl))")
query("balance_115", lambda spark, sf: S.balance_to_least(_of(spark, sf, "SELECT id, label, source, ord FROM pair"), "label", "id").select("id", "label"), expand((lambda d: f"SELECT id, label FROM ranked_pairs WHERE rl <= floor(1.15e0 * (SELECT min(c) FROM (SELECT count(*) AS c FROM pair GROUP BY label) AS m))")(DUCK), DUCK))
sql("fixed_strata", lambda d: f"SELECT label, count(*) AS drawn, count(*) = 20 AS exact FROM ranked_pairs WHERE rl <= 20 GROUP BY label")
sql("frac_cap", lambda d: "SELECT id FROM ranked_frac WHERE NOT part OR k <= floor(0.02e0 / (1 - 0.02e0) * (SELECT count(*) FROM pair WHERE source <> 'src0'))")
sql("dose_cap", lambda d: "SELECT id FROM ranked_dose WHERE part AND k <= floor(0.1e0 * (SELECT count(*) FROM pair))")
sql("ratio_mix", lambda d: "SELECT id, band FROM ranked_bands WHERE k <= floor(CASE band WHEN 'trivial' THEN 0.2e0 WHEN 'medium' THEN 0.3e0 ELSE 0.5e0 END * 300)")
query("oversample_k", lambda spark, sf: S.oversample(_of(spark, sf, "SELECT id, label, source, ord FROM pair"), "id", F.col("source") == "src1", 3).select("id", "source"), expand((lambda d: f"SELECT CASE WHEN i = 0 THEN concat(id) ELSE concat(id, '_rep', i) END AS id, source FROM pair CROSS JOIN {d.seq(3)} AS r WHERE source = 'src1' OR i = 0")(DUCK), DUCK))
sql("distractor_subsample", lambda d: f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY group_id, is_gold ORDER BY {H('ord')}, part) AS pick, sum(is_gold) OVER (PARTITION BY group_id) AS golds, sum(qty) OVER (PARTITION BY group_id) AS chars FROM grouped)
    SELECT group_id, pick, part, is_gold FROM r WHERE chars <= 200 AND (golds = 0 OR is_gold = 1 OR pick <= 2)""")
query("group_cap", lambda spark, sf: S.take(_of(spark, sf, "SELECT group_id, count(*) AS size FROM grouped GROUP BY group_id"), "group_id", 100).select("group_id", "size"), expand((lambda d: "SELECT group_id, size FROM ranked_groups WHERE k <= 100")(DUCK), DUCK))
sql("valid_groups", lambda d: "SELECT CASE WHEN golds = 1 AND size >= 2 THEN group_id END AS group_id, count(*) AS n_rows FROM (SELECT group_id, sum(is_gold) OVER (PARTITION BY group_id) AS golds, count(*) OVER (PARTITION BY group_id) AS size FROM grouped) AS t GROUP BY 1")
sql("anchor_relabel", lambda d: "SELECT id, concat('anchor_', source) AS source, CASE WHEN label = 0 THEN 1e0 ELSE 0e0 END AS s0, CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END AS s1, CASE WHEN label = 2 THEN 1e0 ELSE 0e0 END AS s2, label = 1 AS is_gold FROM pair WHERE id % 5 = 0")
HALF_EVEN = "CASE WHEN {0} - floor({0}) = 0.5e0 AND floor({0}) % 2 = 0 THEN floor({0}) ELSE floor({0} + 0.5e0) END"
sql("split_grouped_strat", lambda d: f"SELECT p.id, CASE WHEN r.k <= greatest(1, {HALF_EVEN.format('(r.q * 0.1e0)')}) THEN 'val' ELSE 'train' END AS part FROM pair p JOIN ranked_strata r ON CAST(floor(p.id / 4) AS bigint) = r.grp")
sql("split_label_strat", lambda d: f"SELECT id, CASE WHEN nl >= 2 AND rl <= least(nl - 1, greatest(1, floor(nl * 0.1e0))) THEN 'val' ELSE 'train' END AS part FROM ranked_pairs")
sql("split_premise_group", lambda d: "SELECT p.id, CASE WHEN r.before < 0.4e0 * r.total THEN 'test' ELSE 'val' END AS part FROM pair p JOIN ranked_premises r ON p.premise = r.premise WHERE p.id % 2 = 0")
sql("split_floor", lambda d: f"SELECT id, CASE WHEN ra <= CASE WHEN n >= 1000 THEN greatest(100, floor(0.1e0 * n)) ELSE greatest(1, least(floor(0.1e0 * n), floor(n / 2))) END THEN 'val' ELSE 'train' END AS part FROM ranked_pairs")
query("split_simple", lambda spark, sf: S.split(_of(spark, sf, "SELECT id, label, source, ord FROM pair"), "id", 0.05).select("id", "part"), expand((lambda d: f"SELECT id, CASE WHEN ra <= greatest(1, floor(n * 0.05e0)) THEN 'val' ELSE 'train' END AS part FROM ranked_pairs")(DUCK), DUCK))
sql("qid_split", lambda d: f"SELECT group_id, CASE WHEN k <= greatest(1, least(q - 1, floor(q * 0.1e0))) THEN 'held' ELSE 'train' END AS part FROM ranked_groups")
sql("pair_unit_split", lambda d: f"SELECT group_id, CASE WHEN k <= greatest(2, floor(0.2e0 * q)) THEN 'val' ELSE 'train' END AS part FROM ranked_groups")
sql("replay_head", lambda d: "SELECT id, 'base' AS part FROM (SELECT id FROM pair WHERE id % 2 = 0 ORDER BY ord LIMIT 50) AS b UNION ALL SELECT id, 'new' AS part FROM pair WHERE id % 2 = 1")
sql("mix_union", lambda d: "SELECT id, source, label, NULL AS language FROM pair WHERE id % 3 = 0 UNION ALL SELECT id, source, NULL AS label, language FROM pair WHERE id % 3 = 1")
sql("allnli_load", lambda d: f"SELECT id, label FROM pair WHERE source IN ('src1', 'src2') AND label < 2 ORDER BY {H('id', 3)} LIMIT 40")
sql("mix_load", lambda d: f"SELECT count(*) AS n, count(*) FILTER (WHERE label NOT IN (0, 1, 2)) AS bad FROM ranked_pairs WHERE ra <= 200")

# ranking, caps and running budgets
sql("cap_per_source", lambda d: "SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY ord) AS k FROM pair) AS t WHERE source NOT LIKE 'src1%' OR k <= 5")
sql("cap_global", lambda d: "SELECT id, source FROM pair WHERE label < 2 ORDER BY source, ord LIMIT 100")
sql("topk_negatives", lambda d: "SELECT group_id, part, soft FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part) AS r FROM grouped WHERE is_gold = 0) AS t WHERE n <= 2 OR r <= 2")
sql("ranked_indices", lambda d: "SELECT group_id, ord, part, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, ord, part) AS rank FROM grouped")
sql("gold_rank2", lambda d: "SELECT group_id, max(CASE WHEN is_gold = 1 AND r = 2 THEN 1 ELSE 0 END) AS second FROM (SELECT group_id, is_gold, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part) AS r FROM grouped) AS t GROUP BY group_id HAVING max(CASE WHEN r = 1 THEN is_gold END) = 0")
sql("argmax_first", lambda d: "SELECT id, pred FROM scored")
sql("majority_label", lambda d: "SELECT source, label FROM (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(ord)) AS k FROM pair GROUP BY source, label) AS t WHERE k = 1")
sql("top_sources", lambda d: "SELECT source, count(*) AS n FROM pair GROUP BY source ORDER BY n DESC, min(ord) LIMIT 5")
query("running_budget_cross", lambda spark, sf: S.budget(_of(spark, sf, "SELECT group_id, count(*) AS size FROM grouped GROUP BY group_id"), "size", "group_id", 500, True).select("group_id", "size"), expand((lambda d: f"SELECT group_id, size FROM ranked_groups WHERE before < 500")(DUCK), DUCK))
query("running_budget_stop", lambda spark, sf: S.budget(_of(spark, sf, "SELECT group_id, count(*) AS size FROM grouped GROUP BY group_id"), "size", "group_id", 500, False).select("group_id", "size"), expand((lambda d: f"SELECT group_id, size FROM ranked_groups WHERE before + size <= 500")(DUCK), DUCK))
sql("split_target_cross", lambda d: f"SELECT group_id, CASE WHEN before < 0.4e0 * total THEN 'test' ELSE 'val' END AS part FROM ranked_groups")
sql("prefix_lengths", lambda d: f"WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT DISTINCT conv_id, CASE WHEN n <= 4 THEN i + 1 ELSE CAST(round(1 + i * (n - 1) / 3e0) AS bigint) END AS prefix FROM c CROSS JOIN {d.seq(4)} AS r WHERE i < n")
sql("prev_two_turns", lambda d: "SELECT conv_id, turn, right(concat(CASE WHEN b IS NULL THEN '' ELSE concat(b, chr(10)) END, coalesce(a, '')), 1500) AS context, substr(text, 1, 400) AS action FROM (SELECT conv_id, turn, text, lag(text, 1) OVER w AS a, lag(text, 2) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) AS t WHERE a IS NOT NULL")
sql("depth_bucket", lambda d: "SELECT CASE WHEN x < 0.2e0 THEN 'start' WHEN x < 0.4e0 THEN 'early' WHEN x < 0.6e0 THEN 'middle' WHEN x < 0.8e0 THEN 'late' ELSE 'end' END AS depth, count(*) AS n FROM (SELECT (id % 100) / 100e0 AS x FROM pair) AS t GROUP BY 1")
