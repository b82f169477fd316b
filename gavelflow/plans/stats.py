"""Evaluation statistics. Each variant has its own key; none are merged."""

from pyspark.sql import functions as F

from gavelflow.operators import evaluate as E

from .base import DUCK, SPARK, expand, query, rank_relation, spark_sql, sql

Y = "CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END"
YB = "CASE WHEN pred_b = gold THEN 1e0 ELSE 0e0 END"

sql("label_source_counts", lambda d: "SELECT label, source, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM pair GROUP BY label, source")
sql("group_atomicity", lambda d: "SELECT count(DISTINCT CASE WHEN group_id % 5 > 0 THEN group_id END) AS n_groups, count(*) FILTER (WHERE group_id % 5 > 0) AS n_grouped, count(*) FILTER (WHERE group_id % 5 = 0) AS ungrouped FROM grouped")
sql("manifest", lambda d: "SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS l0, count(*) FILTER (WHERE label = 1) AS l1, count(*) FILTER (WHERE label = 2) AS l2 FROM pair GROUP BY ROLLUP (source)")
sql("assert_min", lambda d: "SELECT label, count(*) AS n, count(*) >= 50 AS passed FROM pair GROUP BY label")
sql("provenance_ratio", lambda d: "SELECT round(avg(CASE WHEN label < 2 THEN 1e0 ELSE 0e0 END), 6) AS ratio, avg(CASE WHEN label < 2 THEN 1e0 ELSE 0e0 END) >= 0.95e0 AS passed FROM pair")
sql("accuracy", lambda d: f"SELECT round(avg({Y}), 6) AS accuracy FROM scored")
sql("accuracy_by", lambda d: f"SELECT slice, gold, count(*) AS n, round(avg({Y}), 6) AS accuracy FROM scored GROUP BY GROUPING SETS ((slice), (gold), ())")
sql("confusion", lambda d: "SELECT gold, pred, count(*) AS n FROM scored GROUP BY gold, pred")
sql("per_class_prf", lambda d: f"""SELECT i AS class, round(CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1, tp + fn AS support
    FROM (SELECT i, count(*) FILTER (WHERE gold = i AND pred = i) AS tp, count(*) FILTER (WHERE gold <> i AND pred = i) AS fp, count(*) FILTER (WHERE gold = i AND pred <> i) AS fn FROM scored CROSS JOIN {d.seq(3)} AS c GROUP BY i) AS t""")
BIN = "count(*) FILTER (WHERE p1 >= t AND gold = 1) AS tp, count(*) FILTER (WHERE p1 >= t AND gold <> 1) AS fp, count(*) FILTER (WHERE p1 < t AND gold = 1) AS fn"
sql("binary_f1", lambda d: f"SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT {BIN.replace('t ', '0.35e0 ')} FROM item) AS x".replace("0.35e0 AND gold", "0.35e0 AND gold"))
sql("f1_threshold_sweep", lambda d: f"SELECT t, f1 FROM (SELECT t, round(CASE WHEN tp = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM (SELECT t, {BIN} FROM item CROSS JOIN (SELECT round(0.1e0 + 0.05e0 * i, 2) AS t FROM {d.seq(17)} AS s) AS ts GROUP BY t) AS a) AS b ORDER BY f1 DESC, t LIMIT 1")
sql("label_recall", lambda d: f"SELECT gold, round(100e0 * avg({Y}), 2) AS recall FROM scored GROUP BY gold")


def ece(bins, lo="ceil(conf * {n}) - 1", clamp=True):
    b = lo.format(n=bins)
    b = f"greatest({b}, 0)" if clamp else b
    return f"""SELECT round(sum(n * abs(acc - c)) / sum(n), 6) AS ece, count(*) AS used FROM (SELECT {b} AS b, count(*) AS n, avg({Y}) AS acc, avg(conf) AS c FROM scored WHERE conf {'>=' if clamp else '>'} 0 GROUP BY 1) AS x"""


def scored(spark, sf):
    return spark_sql(spark, sf, expand("SELECT slice, conf, pred = gold AS hit FROM scored", SPARK))


for _name, _bins, _rule, _digits, _oracle in (
    ("ece_closed15", 15, E.bin_closed, 6, ece(15)), ("ece_closed10", 10, E.bin_closed, 6, ece(10)), ("ece_open10", 10, E.bin_open, 6, ece(10, clamp=False)), ("ece_open15", 15, E.bin_open, 6, ece(15, clamp=False)),
    ("ece_third15", 15, E.bin_third, 6, ece(15, "least(floor((greatest(conf, 1e0 / 3) - 1e0 / 3) / (2e0 / 3 / {n})), {n} - 1)")), ("ece_dist10", 10, E.bin_floor, 4, ece(10, "least(floor(conf * {n}), {n} - 1)").replace(", 6) AS ece", ", 4) AS ece")),
):
    query(_name, lambda spark, sf, n=_bins, r=_rule, k=_digits: E.ece(scored(spark, sf), "conf", F.col("hit"), n, r, digits=k), expand(_oracle, DUCK))
BRIER = "(p0 - CASE WHEN gold = 0 THEN 1 ELSE 0 END) * (p0 - CASE WHEN gold = 0 THEN 1 ELSE 0 END) + (p1 - CASE WHEN gold = 1 THEN 1 ELSE 0 END) * (p1 - CASE WHEN gold = 1 THEN 1 ELSE 0 END) + (p2 - CASE WHEN gold = 2 THEN 1 ELSE 0 END) * (p2 - CASE WHEN gold = 2 THEN 1 ELSE 0 END)"
sql("brier", lambda d: f"SELECT round(avg({BRIER}), 6) AS brier FROM item")
sql("brier_decision", lambda d: "SELECT round(avg(b), 6) AS brier FROM (SELECT group_id, sum((soft / total - is_gold) * (soft / total - is_gold)) AS b FROM (SELECT *, sum(soft) OVER (PARTITION BY group_id) AS total FROM grouped) AS g WHERE total > 0 GROUP BY group_id) AS x")
sql("trap_clean_acc", lambda d: f"SELECT round(avg(CASE WHEN id % 7 = 0 THEN {Y} END), 6) AS trap, round(avg(CASE WHEN id % 7 <> 0 THEN {Y} END), 6) AS clean FROM scored")
rank_relation("ranked_latency", lambda d: "SELECT latency FROM ballot", "latency", value="latency")


def percentile(p):
    """Between the two nearest ranks, by their distance."""
    at = f"((q - 1) * {p}e0)"
    return f"max(CASE WHEN k = floor({at}) + 1 THEN latency END) + max({at} - floor({at})) * (max(CASE WHEN k = ceil({at}) + 1 THEN latency END) - max(CASE WHEN k = floor({at}) + 1 THEN latency END))"


# Spark takes the percentiles from ranks, as its exact percentile holds all distinct values in one task
query("latency_pct", lambda spark, sf: spark_sql(spark, sf, expand(f"SELECT round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, round(1000 / greatest(1e-3, p50), 6) AS per_second FROM (SELECT {percentile(0.5)} AS p50, {percentile(0.9)} AS p90, {percentile(0.99)} AS p99 FROM ranked_latency) AS t", SPARK)), expand((lambda d: f"SELECT round({d.quantile('latency', 0.5)}, 6) AS p50, round({d.quantile('latency', 0.9)}, 6) AS p90, round({d.quantile('latency', 0.99)}, 6) AS p99, round(1000 / greatest(1e-3, {d.quantile('latency', 0.5)}), 6) AS per_second FROM ballot")(DUCK), DUCK))
sql("latency_rank", lambda d: "SELECT max(CASE WHEN k = floor(q / 2) + 1 THEN latency END) AS p50, max(CASE WHEN k = floor(0.95e0 * q) + 1 THEN latency END) AS p95 FROM ranked_latency")
WILSON = "round((p + 1.9208e0 / n - 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / (n * n))) / (1 + 3.8416e0 / n), 6) AS lo, round((p + 1.9208e0 / n + 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / (n * n))) / (1 + 3.8416e0 / n), 6) AS hi"
sql("wilson_ci", lambda d: f"SELECT slice, {WILSON} FROM (SELECT slice, CAST(count(*) AS double) AS n, avg({Y}) AS p FROM scored GROUP BY slice) AS t")
sql("tier_summary", lambda d: f"SELECT tier, slice, n, round(p, 6) AS acc, {WILSON} FROM (SELECT id % 3 AS tier, slice, CAST(count(*) AS double) AS n, avg({Y}) AS p FROM scored GROUP BY GROUPING SETS ((id % 3), (slice), ())) AS t")
PAIRED = f"SELECT slice, count(*) AS n, round(avg({Y}), 6) AS acc_a, round(avg({YB}), 6) AS acc_b, round(100 * (avg({YB}) - avg({Y})), 6) AS delta_pp, count(*) FILTER (WHERE pred = gold AND pred_b <> gold) AS b, count(*) FILTER (WHERE pred <> gold AND pred_b = gold) AS c FROM scored GROUP BY GROUPING SETS ((slice), ())"


def exact_p(d):
    """Two-sided exact binomial p of b against c: a running sum of logarithms, a row for each term up to the smaller count."""
    terms = "LATERAL VIEW explode(sequence(CAST(0 AS bigint), least(b, c))) AS i" if d.name == "spark" else ", LATERAL (SELECT unnest(range(0, least(b, c) + 1)) AS i) AS _x"
    return f"""SELECT slice, b, c, round(least(1e0, 2 * sum(exp(lc - (b + c) * ln(2e0)))), 6) AS p FROM (SELECT slice, b, c, i, sum(CASE WHEN i = 0 THEN 0e0 ELSE ln((b + c - i + 1) / CAST(i AS double)) END) OVER (PARTITION BY slice ORDER BY i ROWS UNBOUNDED PRECEDING) AS lc
        FROM ({PAIRED}) AS q {terms}) AS t GROUP BY slice, b, c"""


sql("mcnemar_exact", lambda d: exact_p(d))
sql("paired_slices", lambda d: PAIRED)
sql("slice_report", lambda d: f"SELECT slice, id % 4 AS source, count(*) AS n, round(avg({Y}), 6) AS acc FROM scored GROUP BY slice, id % 4")
THIRD = "least(floor((greatest({c}, 1e0 / 3) - 1e0 / 3) / (2e0 / 3 / 15)), 14)"


def gate(d):
    """The paired gate: better, significant (continuity-corrected chi-square over its 5 % point), calibrated and unbiased enough. At least 25 discordant items."""
    arm = lambda y, c: f"(SELECT sum(n * abs(acc - m)) / sum(n) FROM (SELECT {THIRD.format(c=c)} AS bin, count(*) AS n, avg({y}) AS acc, avg(least(greatest({c}, 1e0 / 3), 1e0)) AS m FROM scored GROUP BY 1) AS e)"
    bias = lambda p: f"(SELECT (abs(avg(CASE WHEN {p} = 0 THEN 1e0 ELSE 0e0 END) - 1e0 / 3) + abs(avg(CASE WHEN {p} = 1 THEN 1e0 ELSE 0e0 END) - 1e0 / 3) + abs(avg(CASE WHEN {p} = 2 THEN 1e0 ELSE 0e0 END) - 1e0 / 3)) / 3 FROM scored)"
    return f"""WITH g AS (SELECT count(*) AS n_paired, avg({Y}) AS acc_a, avg({YB}) AS acc_b, count(*) FILTER (WHERE pred = gold AND pred_b <> gold) AS b, count(*) FILTER (WHERE pred <> gold AND pred_b = gold) AS c,
        {arm(Y, 'conf')} AS ece_a, {arm(YB, 'conf_b')} AS ece_b, {bias('pred')} AS pbi_a, {bias('pred_b')} AS pbi_b FROM scored)
    SELECT n_paired, n_paired >= 100 AS enough, round(acc_a, 4) AS acc_a, round(acc_b, 4) AS acc_b, b, c, round(ece_a, 4) AS ece_a, round(ece_b, 4) AS ece_b, round(pbi_a, 4) AS pbi_a, round(pbi_b, 4) AS pbi_b,
        acc_b > acc_a AND b + c >= 25 AND (abs(b - c) - 1) * (abs(b - c) - 1) / CAST(greatest(b + c, 1) AS double) > 3.841458820694124e0 AND ece_b <= ece_a + 0.01e0 AND pbi_b <= pbi_a + 0.02e0 AS passed FROM g"""


sql("gate_eval", gate)
sql("gate_exp01", lambda d: f"SELECT avg(CASE WHEN slice < 5 THEN {YB} END) / avg(CASE WHEN slice < 5 THEN {Y} END) >= 0.995e0 AS floor_ok, round(avg(CASE WHEN slice >= 5 THEN {YB} END) - avg(CASE WHEN slice >= 5 THEN {Y} END), 6) AS lift FROM scored")
sql("pbi_abs", lambda d: f"SELECT round(avg(abs(coalesce(n, 0) / CAST(total AS double) - 1e0 / 3)), 6) AS pbi FROM (SELECT i, n, (SELECT count(*) FROM scored) AS total FROM {d.seq(3)} AS s LEFT JOIN (SELECT pred, count(*) AS n FROM scored GROUP BY pred) AS p ON s.i = p.pred) AS t")
sql("pbi_mixed_rms", lambda d: f"""WITH g AS (SELECT group_id, count(*) AS k, max(CASE WHEN r = 1 THEN slot END) AS chosen FROM (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY ord, part, score) - 1 AS slot, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part, score) AS r FROM grouped) AS t GROUP BY group_id)
    SELECT round(sqrt(avg(gap * gap)), 6) AS pbi FROM (SELECT i, (count(*) FILTER (WHERE chosen = i) * 420 - sum(CASE WHEN i < k THEN 420 / k ELSE 0 END)) / (420e0 * (SELECT count(*) FROM g WHERE k > 1 AND k <= 7)) AS gap FROM g CROSS JOIN {d.seq(7)} AS s WHERE k > 1 AND k <= 7 GROUP BY i) AS x""")
sql("flip_rate", lambda d: "SELECT round(avg(CASE WHEN lo <> hi THEN 1e0 ELSE 0e0 END), 6) AS flips FROM (SELECT sample, min(label) AS lo, max(label) AS hi FROM verdict GROUP BY sample HAVING count(*) > 1) AS t")
sql("decision_acc", lambda d: "SELECT round(avg(hit), 6) AS acc, count(*) AS n FROM (SELECT group_id, max(CASE WHEN r = 1 THEN CAST(is_gold AS double) END) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part, score) AS r FROM grouped) AS g GROUP BY group_id HAVING count(*) > 1 AND sum(soft) > 0) AS x")
sql("anchor_acc", lambda d: f"SELECT round(avg({Y}), 6) AS acc FROM scored WHERE id % 5 = 0")
sql("per_question_acc", lambda d: "SELECT group_id, is_gold AS correct FROM (SELECT group_id, is_gold, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part, score) AS r FROM grouped) AS t WHERE r = 1")
sql("xopt_ce", lambda d: "SELECT round(avg(ce), 6) AS loss, count(*) AS n_groups FROM (SELECT group_id, ln(sum(exp(soft * 10))) - max(CASE WHEN is_gold = 1 THEN soft * 10 END) AS ce FROM grouped GROUP BY group_id HAVING count(*) > 1) AS t")
sql("served_ce", lambda d: "SELECT round(avg(-ln(greatest(g / s, 1e-12))), 6) AS loss, count(*) AS n_groups FROM (SELECT group_id, sum(soft) AS s, max(CASE WHEN is_gold = 1 THEN soft END) AS g FROM grouped GROUP BY group_id HAVING count(*) > 1 AND sum(soft) > 0) AS t")
# ranks of equal scores are averaged, so the scores are counted first
rank_relation("ranked_scores", lambda d: "SELECT p1, count(*) AS n, count(*) FILTER (WHERE gold = 1) AS n1 FROM item GROUP BY p1", "p1", value="p1", before="before", adds="n")
sql("auroc", lambda d: "SELECT round((sum(n1 * (before + (n + 1) / 2e0)) - sum(n1) * (sum(n1) + 1) / 2e0) / CAST(sum(n1) * sum(n - n1) AS double), 6) AS auroc FROM ranked_scores")
rank_relation("ranked_p", lambda d: "SELECT id, p1 FROM item", "p1, id", value="p1")
rank_relation("ranked_q", lambda d: "SELECT id, q1 FROM item", "q1, id", value="q1")
sql("spearman", lambda d: "SELECT round(corr(CAST(p.k AS double), CAST(q.k AS double)), 6) AS rho FROM ranked_p p JOIN ranked_q q ON p.id = q.id")
rank_relation("ranked_risk", lambda d: f"SELECT id, conf, CASE WHEN pred = gold THEN 0 ELSE 1 END AS wrong FROM scored", "conf DESC, id", value="conf", falling=True, before="before", adds="wrong")
sql("aurc", lambda d: "SELECT round(avg((before + wrong) / CAST(k AS double)), 6) AS aurc FROM ranked_risk")
sql("entropy_conf", lambda d: "SELECT id, round(1 + (p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3e0), 6) AS conf FROM item")
PG = "CASE gold WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
sql("proper_reward", lambda d: f"SELECT id, round(greatest(ln({PG}), -9.21e0) + 0.5e0 * ({PG}) / sqrt(p0 * p0 + p1 * p1 + p2 * p2) - ((p0 - CASE WHEN gold <= 0 THEN 1 ELSE 0 END) * (p0 - CASE WHEN gold <= 0 THEN 1 ELSE 0 END) + (p0 + p1 - CASE WHEN gold <= 1 THEN 1 ELSE 0 END) * (p0 + p1 - CASE WHEN gold <= 1 THEN 1 ELSE 0 END)) / 2, 6) AS reward FROM item")
sql("degenerate_guard", lambda d: "SELECT round(max(n) / CAST(sum(n) AS double), 6) AS top_share, max(n) > 0.9e0 * sum(n) AS degenerate FROM (SELECT pred, count(*) AS n FROM scored GROUP BY pred) AS t")
sql("acc_by_k", lambda d: "SELECT k, count(*) AS n, round(avg(hit), 6) AS acc FROM (SELECT group_id, count(*) AS k, max(CASE WHEN r = 1 THEN CAST(is_gold AS double) END) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY soft DESC, ord, part, score) AS r FROM grouped) AS g GROUP BY group_id) AS x GROUP BY k")
sql("model_compare", lambda d: f"SELECT 'a' AS model, slice, round(avg({Y}), 6) AS acc FROM scored GROUP BY slice UNION ALL SELECT 'b' AS model, slice, round(avg({YB}), 6) AS acc FROM scored GROUP BY slice")
sql("active_set_loss", lambda d: f"SELECT id, round(0.6e0 * -ln({PG}) + 0.4e0 * ({BRIER}) / 3, 6) AS loss FROM item")
sql("distinct_counts", lambda d: "SELECT count(DISTINCT premise) AS premises, count(DISTINCT source) AS sources FROM pair")
