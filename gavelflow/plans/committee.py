"""Committee votes: tally, policy, overrides, soft labels, early exit, export."""

from pyspark.sql import functions as F

from gavelflow.operators import committee as C

from .base import DUCK, SPARK, expand, query, rank_relation, spark_sql, sql

#: The policy reads a tally row: counts of ok votes by label, votes asked for, generator label.
TOP = "CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END"
MOST = "greatest(c0, c1, c2)"
TIE = "(CASE WHEN c0 = greatest(c0, c1, c2) THEN 1 ELSE 0 END + CASE WHEN c1 = greatest(c0, c1, c2) THEN 1 ELSE 0 END + CASE WHEN c2 = greatest(c0, c1, c2) THEN 1 ELSE 0 END > 1)"
KEEP = f"(n_ok = 0 OR {TIE} OR {MOST} * 2 <= n_ok OR ({TOP} <> gen AND {MOST} < 2))"
OVERRIDE = f"({MOST} = n_ok AND {TOP} <> gen)"
#: Names of outcomes, and the changes of label whose override counts as a harvested control.
CONTROL = f"((gen = 1 AND {TOP} <> 1) OR (gen = 0 AND {TOP} = 2))"
RESOLVED = f"""(SELECT sample, gen, n_ok, judges, c0, c1, c2, CASE WHEN {KEEP} THEN gen ELSE {TOP} END AS final,
    CASE WHEN n_ok = 0 THEN 'no_judge_verdicts' WHEN {TIE} OR {MOST} * 2 <= n_ok THEN 'committee_split_tie' WHEN {TOP} <> gen AND {MOST} < 2 THEN 'insufficient_quorum'
         WHEN {OVERRIDE} THEN 'unanimous_label_override' WHEN {MOST} < n_ok THEN 'committee_split' WHEN judges > n_ok THEN 'partial_committee_failure' ELSE 'unanimous_consensus' END AS kind,
    CASE WHEN {KEEP} THEN 'high' WHEN {OVERRIDE} THEN CASE WHEN {CONTROL} THEN CASE WHEN judges > n_ok THEN 'medium' ELSE 'low' END ELSE CASE WHEN judges > n_ok THEN 'high' ELSE 'medium' END END
         WHEN {MOST} < n_ok THEN 'high' WHEN judges > n_ok THEN 'medium' ELSE 'none' END AS severity,
    CASE WHEN n_ok = 0 THEN 0e0 WHEN {KEEP} THEN {MOST} / CAST(n_ok AS double) WHEN {OVERRIDE} THEN round(n_ok / CAST(judges AS double), 3) ELSE {MOST} / CAST(n_ok AS double) END AS confidence,
    CASE WHEN n_ok = 0 THEN 'all_judges_failed' WHEN {TIE} OR {MOST} * 2 <= n_ok THEN 'committee_split_tie_kept_generator_label' WHEN {TOP} <> gen AND {MOST} < 2 THEN 'insufficient_quorum_kept_generator_label'
         WHEN {OVERRIDE} THEN CASE WHEN gen = 1 AND {TOP} = 0 THEN 'committee_adversarial_negative_control' WHEN gen = 1 AND {TOP} = 2 THEN 'committee_neutral_boundary_control' WHEN gen = 0 AND {TOP} = 2 THEN 'committee_relabelled_neutral' ELSE 'committee_unanimous_override' END
         WHEN {MOST} < n_ok THEN concat('majority_committee_vote_', {MOST}, '_of_', n_ok) WHEN judges > n_ok THEN 'unanimous_with_judge_failures' ELSE 'unanimous_committee_consensus' END AS reason FROM tally) AS resolved"""
REVIEW = "(kind <> 'unanimous_consensus')"

sql("vote_tally", lambda d: "SELECT sample, label, count(*) AS votes FROM verdict WHERE status = 'ok' GROUP BY sample, label")
query("resolve_sample", lambda spark, sf: C.resolve(C.tally(spark_sql(spark, sf, expand("SELECT sample, gen, label, status FROM verdict", SPARK)))).select("sample", "gen", "final", "kind", "severity", F.round("confidence", 6).alias("confidence"), "needs_review"), expand((lambda d: f"SELECT sample, gen, final, kind, severity, round(confidence, 6) AS confidence, {REVIEW} AS needs_review FROM {RESOLVED}")(DUCK), DUCK))
sql("override_reason", lambda d: f"SELECT sample, reason, severity, round(confidence, 6) AS confidence FROM {RESOLVED} WHERE kind = 'unanimous_label_override'")
sql("soft_labels", lambda d: "SELECT sample, CASE WHEN n_ok = 0 THEN 1e0 / 3e0 ELSE round(c0 / n_ok, 3) END AS s0, CASE WHEN n_ok = 0 THEN 1e0 / 3e0 ELSE round(c1 / n_ok, 3) END AS s1, CASE WHEN n_ok = 0 THEN 1e0 / 3e0 ELSE round(c2 / n_ok, 3) END AS s2 FROM (SELECT sample, CAST(n_ok AS double) AS n_ok, c0, c1, c2 FROM tally) AS t")
sql("expected_judges", lambda d: "SELECT p.id AS sample, CASE WHEN count(v.judge) = 0 THEN 5 ELSE count(v.judge) END AS expected FROM pair p LEFT JOIN verdict v ON p.id = v.sample GROUP BY p.id")
sql("include_overrides", lambda d: f"SELECT sample, final AS label, reason AS label_source FROM {RESOLVED} WHERE NOT {REVIEW} OR (kind = 'unanimous_label_override' AND severity = 'low')")
sql("review_queue", lambda d: f"SELECT r.sample, r.kind, r.severity, {d.collect('v.label', 'v.judge')} AS votes FROM {RESOLVED} JOIN verdict v ON resolved.sample = v.sample WHERE {REVIEW} GROUP BY r.sample, r.kind, r.severity".replace("r.sample, r.kind, r.severity", "resolved.sample, resolved.kind, resolved.severity"))
sql("disagreement_stats", lambda d: f"SELECT kind AS disagreement, count(*) AS n FROM {RESOLVED} GROUP BY kind")
sql("early_exit", lambda d: """WITH r AS (SELECT sample, judge, label, status, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER w AS n_ok, min(CASE WHEN status = 'ok' THEN label END) OVER w AS lo, max(CASE WHEN status = 'ok' THEN label END) OVER w AS hi,
        row_number() OVER (PARTITION BY sample ORDER BY judge) AS k FROM verdict WINDOW w AS (PARTITION BY sample ORDER BY judge ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT sample, min(CASE WHEN n_ok >= 2 AND lo = hi THEN k END) AS settled FROM r GROUP BY sample)
    SELECT r.sample, r.judge, r.label FROM r JOIN s ON r.sample = s.sample WHERE s.settled IS NULL OR r.k <= s.settled""")
sql("pending_batches", lambda d: """WITH panel AS (SELECT DISTINCT judge FROM verdict), need AS (SELECT sample, judge FROM (SELECT DISTINCT sample FROM verdict) AS s CROSS JOIN panel),
    done AS (SELECT n.judge, CAST(floor(n.sample / 5) AS bigint) AS batch, count(*) AS size, count(v.sample) AS have FROM need n LEFT JOIN verdict v ON n.sample = v.sample AND n.judge = v.judge GROUP BY 1, 2)
    SELECT judge, batch, size - have AS missing FROM done WHERE have < size""")
sql("verdict_rows", lambda d: "SELECT sample, judge, CASE WHEN status <> 'ok' THEN NULL WHEN label = gen THEN 1 ELSE 0 END AS agreed FROM verdict")
rank_relation("ranked_resolved", lambda d: f"SELECT sample, final, {REVIEW} AS review, md5(concat('42:', sample)) AS h FROM {RESOLVED}", "h", by="review")
sql("consensus_export", lambda d: "SELECT sample, final AS label, CASE WHEN review THEN 'flagged' WHEN k <= greatest(1, floor(0.1 * q)) THEN 'val' ELSE 'train' END AS part FROM ranked_resolved")
sql("replay_checkpoint", lambda d: f"""SELECT count(*) AS samples, count(*) FILTER (WHERE NOT {REVIEW}) AS clean, count(*) FILTER (WHERE NOT {REVIEW}) >= 100 AS enough, round(avg(CASE WHEN n_ok > 0 THEN 1e0 ELSE 0e0 END), 6) AS provenance FROM {RESOLVED}""")
