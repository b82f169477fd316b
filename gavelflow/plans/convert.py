"""Record converters: nested tasks to candidate rows, rows back to decisions, canned generators.

Task records that the driver's tables lack are literal rows; conversions of
real rows run over whole tables.
"""

from .base import sql


sql("conv_prometheus", lambda d: "SELECT id, CASE WHEN s >= 4 THEN 1 WHEN s <= 2 THEN 0 ELSE 2 END AS label FROM (SELECT id, try_cast(score AS int) AS s FROM (VALUES (1, '5'), (2, '3'), (3, '1'), (4, 'x')) AS t(id, score)) AS u WHERE s IS NOT NULL")
sql("conv_helpsteer", lambda d: "SELECT * FROM (SELECT id, CASE WHEN correctness < 0 THEN NULL WHEN correctness >= 4 AND coherence >= 4 THEN 1 WHEN coherence >= 3 AND correctness <= 1 THEN 0 WHEN correctness IN (2, 3) THEN 2 END AS label FROM (VALUES (1, 4, 4), (2, 0, 4), (3, 2, 1), (4, 3, 4), (5, 4, 2), (6, -1, 4), (7, 1, 2)) AS t(id, correctness, coherence)) AS u WHERE label IS NOT NULL")
CODE = "CASE WHEN i < 26 THEN chr(CAST(65 + i AS int)) ELSE concat(chr(CAST(64 + floor(i / 26) AS int)), chr(CAST(65 + i % 26 AS int))) END"
sql("lev_codes", lambda d: f"SELECT i, {CODE} AS code FROM {d.seq(255)} AS s")
sql("option_code", lambda d: f"SELECT i, {CODE} AS code FROM {d.seq(60)} AS s")
sql("gate_slices", lambda d: "SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'floor' WHEN source IN ('src3', 'src4', 'src5', 'src6') THEN 'medium' ELSE 'hard' END AS slice, count(*) AS n FROM pair GROUP BY 1")
sql("multipage_premise", lambda d: f"SELECT conv_id, {d.collect(chr(99) + 'oncat(' + chr(39) + '[page ' + chr(39) + ', turn, ' + chr(39) + '] ' + chr(39) + ', text)', 'turn')} AS premise FROM (SELECT DISTINCT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) AS c GROUP BY conv_id")
sql("snli_ve", lambda d: "SELECT id, CASE label WHEN 0 THEN 'contradiction' WHEN 1 THEN 'entailment' ELSE 'neutral' END AS label, concat('image_', id, '.png') AS image FROM pair")
sql("bench_grade", lambda d: "SELECT count(*) AS n, round(avg(CASE WHEN (p1 >= 0.35e0) = (gold = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM item")

# canned generators: arithmetic over a counter, distractors distinct by construction
sql("scenario_merge", lambda d: f"SELECT family, count(*) AS n FROM (SELECT i, i % 4 AS family FROM {d.seq(100)} AS s) AS new_ WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = new_.i AND o.doc_id % 3 = 0) GROUP BY family")
