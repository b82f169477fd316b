"""Queries that run a stream over the events table to its end."""

from pyspark.sql import functions as F

from gavelflow.streaming import verdicts as V

from .base import DUCK, expand, query, sql
from .files import folder


def streamed(make):
    def run(spark, sf):
        top = folder(spark)
        return make(V.stream_of(spark, f"{sf}/events.parquet"), f"{top}/checkpoint", f"{top}/out")

    return run


query("upsert_stream", streamed(lambda s, c, o: V.upsert(s, c, o).select("sample", "judge", "seq", "label")), expand("SELECT sample, judge, seq, label FROM verdict", DUCK))
query("append_log", streamed(lambda s, c, o: V.run(s.select("seq", "sample", "judge"), c, o)), expand("SELECT seq, sample, judge FROM ballot", DUCK))
# the same over the finished table: votes up to the one that settles a sample; windows that the watermark has passed
query("stateful_early_exit", streamed(lambda s, c, o: V.run(V.early_exit(s), c, o)), expand("""WITH r AS (SELECT sample, seq, judge, count(*) FILTER (status = 'ok') OVER w AS n, min(label) FILTER (status = 'ok') OVER w AS lo, max(label) FILTER (status = 'ok') OVER w AS hi FROM ballot WINDOW w AS (PARTITION BY sample ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT sample, min(seq) FILTER (n >= 2 AND lo = hi) AS at_ FROM r GROUP BY sample) SELECT r.sample, r.seq, r.judge, coalesce(r.seq = s.at_, false) AS settled FROM r JOIN s ON r.sample = s.sample WHERE s.at_ IS NULL OR r.seq <= s.at_""", DUCK))
query("watchdog_stream", streamed(lambda s, c, o: V.run(V.watchdog(s), c, o).withColumn("start", F.unix_timestamp("start"))), expand("SELECT CAST(epoch(date_trunc('hour', ts)) AS bigint) AS start, count(*) AS n, count(*) FILTER (status <> 'ok') AS failed FROM ballot GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ballot)", DUCK))

# extensions over the event and order tables
sql("ext_tumbling", lambda d: f"SELECT event_type, CAST(floor({d.epoch('ts')} / 3600) AS bigint) AS hour_, count(*) AS n FROM events GROUP BY 1, 2")
sql("ext_sessions", lambda d: f"SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN t - before > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, event_id, {d.epoch('ts')} AS t, lag({d.epoch('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS a) AS b GROUP BY user_id, session")
sql("ext_cube", lambda d: "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("ext_asof", lambda d: "SELECT event_id, o_orderkey FROM (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= ts) AS t WHERE k = 1")
sql("ext_html_text", lambda d: f"SELECT page_id, length({d.rx('html', '<[^>]*>', ' ')}) AS n FROM pages")
sql("ext_top_customers", lambda d: "SELECT n_name, c_custkey, round(total, 2) AS total FROM (SELECT n_name, c_custkey, total, row_number() OVER (PARTITION BY n_name ORDER BY total DESC, c_custkey) AS k FROM (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey) AS s JOIN nation ON c_nationkey = n_nationkey) AS t WHERE k <= 3")
