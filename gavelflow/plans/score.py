"""Scores on logit and probability columns; batches by token budget."""

from pyspark.sql import functions as F

from gavelflow.operators import evaluate as E

from .base import DUCK, SPARK, expand, query, rank_relation, spark_sql, sql

SM = "exp({0} / {1}) / (exp(z0 / {1}) + exp(z1 / {1}) + exp(z2 / {1}))"
sql("softmax", lambda d: f"SELECT id, round({SM.format('z0', '0.7e0')}, 6) AS p0, round({SM.format('z1', '0.7e0')}, 6) AS p1, round({SM.format('z2', '0.7e0')}, 6) AS p2 FROM logit")
sql("score_margin", lambda d: "SELECT id, round(p1 - p0, 6) AS score FROM item")
sql("score_logodds", lambda d: "SELECT id, round(z1 - z0, 6) AS score FROM logit")
sql("score_contrastive", lambda d: "SELECT id, round(p1 / (p1 + p0 + 1e-6), 6) AS score FROM item")
sql("score_entailment", lambda d: "SELECT id, round(p1, 6) AS score FROM item")
K = "CASE WHEN k = 2 THEN 1.637e0 WHEN k BETWEEN 3 AND 5 THEN 1.251e0 WHEN k BETWEEN 6 AND 10 THEN 1.42e0 ELSE 1.983e0 END"
sql("bucketed_temperature", lambda d: f"SELECT group_id, count(*) AS k, {K.replace('k ', 'count(*) ')} AS t FROM grouped GROUP BY group_id")
SLOT = "(SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ord, part, score) - 1 AS slot, count(*) OVER (PARTITION BY group_id) AS kk FROM grouped) AS g"
sql("debias_average", lambda d: f"SELECT group_id, slot, round(avg(soft * (1 + ((slot + i) % kk) / 100e0)), 6) AS score FROM {SLOT} CROSS JOIN {d.seq(20)} AS s WHERE i < kk GROUP BY group_id, slot")
# a model with a liking for first positions: what it gives the option that stands at a position in a shift
query("debias_average_probs", lambda spark, sf: E.debias(spark_sql(spark, sf, expand(f"SELECT group_id, i AS shift, slot AS position, kk, 1e0 / (1 + slot) AS x FROM {SLOT} CROSS JOIN {SPARK.seq(20)} AS s WHERE i < kk AND kk <= 20", SPARK)), "group_id", "shift", "position", "kk", "x").select("group_id", "slot", F.round("score", 6).alias("prob")), expand((lambda d: f"SELECT group_id, slot, CASE WHEN kk = 1 THEN 1e0 ELSE round(avg(1e0 / (1 + ((slot + i) % kk))), 6) END AS prob FROM {SLOT} CROSS JOIN {d.seq(20)} AS s WHERE i < kk AND kk <= 20 GROUP BY group_id, slot, kk")(DUCK), DUCK))
sql("rerank", lambda d: "SELECT group_id, ord, part, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part, score) AS rank, round(exp(soft) / sum(exp(soft)) OVER (PARTITION BY group_id), 6) AS prob FROM grouped")
sql("decide", lambda d: "SELECT group_id, part AS choice, round(prob, 6) AS prob FROM (SELECT group_id, part, exp(soft) / sum(exp(soft)) OVER (PARTITION BY group_id) AS prob, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part, score) AS r FROM grouped) AS t WHERE r = 1")
NAME = "CASE pred WHEN 0 THEN 'contradiction' WHEN 1 THEN 'entailment' ELSE 'neutral' END"
sql("judge", lambda d: f"SELECT id, {NAME} AS label, round(p0, 6) AS contradiction, round(p1, 6) AS entailment, round(p2, 6) AS neutral FROM scored")
sql("grade", lambda d: f"SELECT id, {NAME} AS label, pred = 1 AS passed FROM scored")
sql("rate", lambda d: "SELECT group_id, round(sum(slot * soft) / sum(soft), 6) AS rating FROM (SELECT group_id, soft, row_number() OVER (PARTITION BY group_id ORDER BY ord, part, score) - 1 AS slot FROM grouped) AS t GROUP BY group_id HAVING sum(soft) > 0")
sql("noul_true", lambda d: "SELECT id, round(greatest(0e0, least(1e0, p1 + 0.5e0 * p2)), 6) AS p_true FROM item")
LEN = "least(8192, 32 + length(premise) - length(replace(premise, ' ', '')) + length(hypothesis) - length(replace(hypothesis, ' ', '')) + 2)"
CAP = "CASE " + " ".join(f"WHEN n <= {64 << i} THEN {64 << i}" for i in range(12)) + f" ELSE {64 << 11} END"
sql("token_lengths", lambda d: f"SELECT id, {LEN} AS n FROM pair")
rank_relation("ranked_caps", lambda d: f"SELECT id, n, {CAP} AS cap FROM (SELECT id, {LEN} AS n FROM pair) AS a", "id", value="id", by="cap")
rank_relation("ranked_lengths", lambda d: f"SELECT id, {LEN} AS n FROM pair", "n DESC, id", value="n", falling=True)
BUCKET = "(SELECT id, n, cap, CAST(floor((k - 1) / greatest(1, floor(4096 / cap))) AS bigint) AS batch FROM ranked_caps) AS t"
rank_relation("ranked_batches", lambda d: f"SELECT cap, batch, md5(concat('42:1:', cap, ':', batch)) AS h FROM {BUCKET} GROUP BY cap, batch", "h")
rank_relation("ranked_firsts", lambda d: "SELECT group_id, min(ord) AS first FROM grouped GROUP BY group_id", "first", value="first")
rank_relation("ranked_offsets", lambda d: "SELECT CAST(floor(id / 50) AS bigint) AS batch, max(id % 7) AS local_max FROM pair GROUP BY 1", "batch", value="batch", before="offset_", adds="local_max + 1")
sql("token_bucket", lambda d: f"SELECT id, cap, batch FROM {BUCKET}")
sql("skip_prefix", lambda d: f"SELECT id, cap, batch FROM {BUCKET} WHERE batch >= 2")
sql("epoch_shuffle", lambda d: "SELECT cap, batch, k AS position FROM ranked_batches")
sql("length_grouped", lambda d: "SELECT id, n, CAST(floor((k - 1) / 8) AS bigint) AS megabatch FROM ranked_lengths")
sql("group_compact", lambda d: "SELECT group_id, k - 1 AS compact FROM ranked_firsts")
sql("group_offset", lambda d: "SELECT batch, local_max, CAST(offset_ AS bigint) AS offset_ FROM ranked_offsets")
sql("adjacency", lambda d: "SELECT a.ord AS a, a.part AS pa, b.ord AS b, b.part AS pb FROM grouped a JOIN grouped b ON a.group_id = b.group_id")
sql("pad_multiple", lambda d: f"SELECT cap, batch, CAST(ceil(max(n) / 8e0) * 8 AS bigint) AS padded FROM {BUCKET} GROUP BY cap, batch")
sql("left_truncate", lambda d: "SELECT id, CASE WHEN length(premise) > 60 THEN concat(substr(premise, 1, 10), substr(premise, length(premise) - 49, 50)) ELSE premise END AS text FROM pair")
sql("resume_skip", lambda d: "SELECT judge AS mode, count(*) AS have, count(*) >= 100 AS skip FROM verdict GROUP BY judge")
sql("best_checkpoint", lambda d: """WITH e AS (SELECT slice AS epoch, avg(CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END) AS main, avg(CASE WHEN pred_b = gold THEN 1e0 ELSE 0e0 END) AS anchor FROM scored GROUP BY slice),
    b AS (SELECT epoch, main, anchor, max(main) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT epoch, round(main, 6) AS main, coalesce(main > before, true) AS better FROM b""")
#: Tier weights, and the scales of speed and cost.
TIERS = {0: 0.14, 1: 0.28, 2: 0.28, 3: 0.30}
SPEED = "greatest(0e0, least(100e0, 100 - 20 * log10((2 * ({0}) + 0.15e0) / 0.1e0)))"
sql("composite_score", lambda d: f"""WITH t AS (SELECT slice AS model, id % 4 AS tier, avg(CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END) AS acc FROM scored GROUP BY 1, 2),
    i AS (SELECT model, sum(w * 100 * acc) / sum(w) AS intelligence FROM t JOIN (VALUES {', '.join(f'({k}, {w}e0)' for k, w in TIERS.items())}) AS v(k, w) ON t.tier = v.k GROUP BY model),
    b AS (SELECT slice AS model, greatest(ceil(conf * 10) - 1, 0) AS bin, count(*) AS n, avg(CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END) AS acc, avg(conf) AS mean FROM scored WHERE id % 4 = 3 GROUP BY 1, 2),
    e AS (SELECT model, greatest(0e0, least(100e0, 100 * (1 - sum(n * abs(acc - mean)) / sum(n) / 0.5e0))) AS calibration FROM b GROUP BY model),
    o AS (SELECT slice AS model, {d.quantile('conf_b', 0.5)} AS p50, {d.quantile('conf_b', 0.95)} AS p95, avg(0.001e0 * (1 + id % 5)) AS usd FROM scored GROUP BY slice),
    a AS (SELECT i.model, intelligence, calibration, ({SPEED.format('p50')} + {SPEED.format('p95')}) / 2 AS speed, greatest(0e0, least(100e0, 100 - 30 * log10(usd / 0.001e0))) AS cost FROM i JOIN o ON i.model = o.model JOIN e ON i.model = e.model)
    SELECT model, round(exp(0.25e0 * (ln(greatest(intelligence, 1e0)) + ln(greatest(calibration, 1e0)) + ln(greatest(speed, 1e0)) + ln(greatest(cost, 1e0)))), 6) AS score FROM a""")
