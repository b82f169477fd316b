"""The judge store: verdicts, batches, runs and final labels as relations (resume, upsert, export, watch)."""

from gavelflow.operators.clean import purge_non_ok

from .base import DUCK, SPARK, expand, query, spark_sql, sql

FINAL = """CASE WHEN n_ok = 0 THEN gen WHEN c0 * 2 > n_ok AND (gen = 0 OR c0 >= 2) THEN 0 WHEN c1 * 2 > n_ok AND (gen = 1 OR c1 >= 2) THEN 1 WHEN c2 * 2 > n_ok AND (gen = 2 OR c2 >= 2) THEN 2 ELSE gen END"""
RUNS = "(SELECT run AS run_id, min(ts) AS started_at, max(ts) AS finished_at, CASE WHEN run = 3 THEN 'running' WHEN run = 1 THEN 'failed' ELSE 'completed' END AS status, '[\"a\",\"b\"]' AS models, count(*) AS total FROM ballot GROUP BY run) AS runs"

sql("judge_performance", lambda d: f"""SELECT v.run, v.judge, count(*) AS verdicts, count(*) FILTER (WHERE v.status = 'ok') AS ok,
    round(count(*) FILTER (WHERE v.status = 'ok') / count(*), 4) AS success_rate, round(avg(CASE WHEN v.label = v.gen THEN 1e0 ELSE 0e0 END), 6) AS agreement,
    round(avg(CASE WHEN f.final IS NULL THEN NULL WHEN v.label = f.final THEN 1e0 ELSE 0e0 END), 6) AS consensus, round(avg(v.latency), 1) AS latency
    FROM verdict v LEFT JOIN (SELECT sample, {FINAL} AS final FROM tally) f ON v.sample = f.sample GROUP BY v.run, v.judge""")
sql("judge_summary", lambda d: "SELECT judge, count(*) AS verdicts, count(*) FILTER (WHERE status = 'ok') AS ok FROM verdict WHERE run = 2 GROUP BY judge ORDER BY judge")
sql("latest_resumable_run", lambda d: f"""SELECT run_id, status FROM {RUNS} WHERE status <> 'completed' AND models = '["a","b"]' ORDER BY started_at DESC LIMIT 1""")
sql("count_verdicts", lambda d: "SELECT run, judge, count(*) AS n FROM verdict WHERE judge IN ('click', 'view', 'error') GROUP BY run, judge")
sql("persisted_ok_count", lambda d: "SELECT run, count(*) FILTER (WHERE status = 'ok') AS n FROM verdict GROUP BY run")
sql("run_exists", lambda d: "SELECT r.run, EXISTS (SELECT 1 FROM ballot b WHERE b.run = r.run) AS there FROM (VALUES (0), (3), (9)) AS r(run)")
sql("persisted_verdicts", lambda d: "SELECT sample, judge, label FROM verdict WHERE sample IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0) AND status = 'ok'")
sql("upsert_verdicts", lambda d: f"SELECT sample, judge, seq, label, status FROM {d.latest('ballot', 'sample, judge', 'seq')} AS v")
sql("upsert_final_labels", lambda d: f"SELECT run, sample, label FROM {d.latest('ballot', 'run, sample', 'seq')} AS v")
query("purge_non_ok", lambda spark, sf: purge_non_ok(purge_non_ok(spark_sql(spark, sf, expand("SELECT seq, sample, judge, status, run FROM ballot", SPARK)), run=1), judge="click", run=2).drop("run"), expand("SELECT seq, sample, judge, status FROM ballot WHERE NOT (status <> 'ok' AND (run = 1 OR (judge = 'click' AND run = 2)))", DUCK))
sql("run_lifecycle", lambda d: f"SELECT run_id, status, total FROM {RUNS}")
sql("record_batch", lambda d: "SELECT run, judge, CAST(floor(sample / 50) AS bigint) AS batch, count(*) AS size, round(max(latency), 6) AS latency FROM ballot GROUP BY ALL")
sql("export_judge_ok", lambda d: "SELECT v.sample, v.label, p.source FROM verdict v JOIN pair p ON v.sample = p.id WHERE v.judge = 'click' AND v.status = 'ok'")
sql("export_validated", lambda d: """WITH ok AS (SELECT sample, label FROM verdict WHERE status = 'ok' AND judge = 'view' AND run = 2)
    SELECT p.id, v.label, p.label AS before, v.sample IS NULL AS excluded FROM pair p LEFT JOIN ok v ON p.id = v.sample""")
sql("watchdog_window", lambda d: f"""WITH last AS (SELECT * FROM ballot ORDER BY seq DESC LIMIT 40), edge AS (SELECT max({d.epoch('ts')}) AS t FROM ballot)
    SELECT count(*) AS recent, round(avg(CASE WHEN status <> 'ok' THEN 1e0 ELSE 0e0 END), 6) AS failure_rate, (SELECT count(*) FROM ballot, edge WHERE {d.epoch('ts')} > t - 3600) AS last_hour FROM last""")
sql("run_status", lambda d: "SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS error, count(*) AS total FROM ballot")
sql("progress_poll", lambda d: "SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) AS total, count(*) FILTER (WHERE status = 'ok') >= 0.75 * count(*) AS done FROM verdict")
sql("stage_status", lambda d: f"SELECT judge AS stage, status, status = 'ok' AS done FROM {d.latest('ballot', 'judge', 'seq')} AS v")
sql("trajectory_stats", lambda d: "SELECT sample AS episode, count(*) AS steps, round(avg(latency), 6) AS latency, round(avg(CASE WHEN label = sample % 3 THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM ballot GROUP BY sample")
sql("delta_report", lambda d: """WITH now AS (SELECT slice, count(*) AS n, avg(CASE WHEN pred = gold THEN 1e0 ELSE 0e0 END) AS acc FROM scored GROUP BY slice),
    old AS (SELECT slice, avg(CASE WHEN pred_b = gold THEN 1e0 ELSE 0e0 END) AS acc FROM scored WHERE slice < 8 GROUP BY slice)
    SELECT n.slice, n.n, round(n.acc, 6) AS acc, round(coalesce(o.acc, 0e0), 6) AS before, round(n.acc - coalesce(o.acc, 0e0), 6) AS delta FROM now n LEFT JOIN old o ON n.slice = o.slice""")
