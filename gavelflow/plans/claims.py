"""Claims about texts, tables, pictures, calls and states; long documents around a statement; decisions of the second format."""

import json

from pyspark.sql import functions as F

from gavelflow.operators import mutate as M
from gavelflow.operators.ranks import draw, ranked

from .base import DUCK, SPARK, expand, literal, query, rank_relation, spark_sql, sql
from .generate import N, choice, key, layers, number

# statements put wrong: whole premises of the pair relation
NUMBER = r"\b(\d+)\b"


def corrupted_sql(x, k):
    """The oracle's form of a corrupted statement."""
    more = f"[5, 10, 100][{DUCK.draw(k, 3)} + 1]"
    flips = " ".join(f"WHEN regexp_matches({x}, '\\b{a}\\b', 'i') THEN regexp_replace({x}, '\\b{a}\\b', '{b}', 'i')" for a, b in M.ANTONYMS)
    return f"""CASE WHEN length(regexp_extract({x}, '{NUMBER}', 1)) BETWEEN 1 AND 30 THEN regexp_replace({x}, '{NUMBER}', CAST(CAST(regexp_extract({x}, '{NUMBER}', 1) AS hugeint) + {more} AS varchar)) {flips} ELSE '{M.DENIED}' || lower(substr({x}, 1, 1)) || substr({x}, 2) END"""


query(
    "corrupt_numeric", lambda spark, sf: spark_sql(spark, sf, expand("SELECT id, premise FROM pair", SPARK)).select("id", M.corrupted(F.col("premise"), F.concat(F.lit("c:"), F.col("id").cast("string"))).alias("x")),
    expand(f"SELECT id, {corrupted_sql('premise', chr(39) + 'c:' + chr(39) + ' || id')} AS x FROM pair", DUCK),
)


def flips(spark, sf):
    d = spark_sql(spark, sf, expand("SELECT id, premise FROM pair", SPARK))
    return M.counterfactual(d, "premise", F.concat(F.lit("f:"), F.col("id").cast("string"))).select("id", "axis", "flipped")


query("counterfactual", flips)

#: Statements that follow from their texts, made by the modes: the rows that are turned round, each with its control.
SAID = " UNION ALL ".join(f"SELECT {literal(p)} AS premise, {literal(h)} AS hypothesis" for p, h in [
    ("The plant made 40 cars a day in 1998.", "In 1998 the plant made 40 cars a day."), ("Growth exceeded 12% in London.", "Growth in London exceeded 12%."), ("Acme Corp paid $12 million.", "Acme Corp paid $12 million for it."), ("More than half agreed.", "The majority agreed."),
    ("Water boils at 100 degrees.", "It boils at 100 degrees."), ("The sky is blue.", "It is blue."),
])


def turned(spark, sf):
    d = spark.sql(SAID).withColumn("key", F.concat(F.lit("adv:"), "hypothesis"))
    d = M.counterfactual(d, "hypothesis", F.col("key"))
    wrong = d.select("premise", F.col("flipped").alias("hypothesis"), F.lit(0).alias("label"), F.concat(F.lit("counterfactual_"), "axis", F.lit("_flip")).alias("kind"))
    return wrong.unionByName(d.select("premise", "hypothesis", F.lit(1).alias("label"), F.lit("positive_control").alias("kind")))


query("mode_counterfactual", turned)

# long documents: a premise among paragraphs of a pool of bounded size
POOL = "SELECT premise, md5(concat('7:', premise)) AS h FROM (SELECT DISTINCT premise FROM pair WHERE length(premise) BETWEEN 20 AND 400) AS u ORDER BY h, premise LIMIT 61"


def hay(few, many, drop, corrupt):
    def run(spark, sf):
        pairs = spark_sql(spark, sf, expand("SELECT id, premise, label FROM pair", SPARK))
        pool = spark_sql(spark, sf, expand(POOL, SPARK)).agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "premise"))), lambda x: x["premise"]).alias("fillers"))
        return M.haystack(pairs, pool, few, many, drop, corrupt)

    at = lambda what: f"'hay:' || id || ':{what}'"
    dropped = "OR (roll >= " + str(drop) + " AND label = 0)" if corrupt > drop else ""
    oracle = f"""WITH pool AS (SELECT list(premise ORDER BY h, premise) AS f FROM ({POOL}) AS p),
        a AS (SELECT id, premise, label, f, {DUCK.draw(at('roll'), 1000)} / 1000 AS roll, least({few} + {DUCK.draw(at('n'), many - few + 1)}, len(f)) AS n, {DUCK.draw(at('start'), 'len(f)')} AS start FROM pair, pool WHERE len(f) > 0),
        b AS (SELECT *, list_transform(range(0, n), lambda k: f[((start + k) % len(f)) + 1]) AS around, {DUCK.draw(at('place'), '(n + 1)')} AS place, CASE WHEN roll < {drop} {dropped} THEN CASE WHEN roll < {corrupt} AND label = 1 AND roll >= {drop} THEN 'corrupt' ELSE 'drop' END WHEN roll < {corrupt} AND label = 1 THEN 'corrupt' ELSE 'embed' END AS kind FROM a),
        c AS (SELECT id, label, kind, CASE kind WHEN 'drop' THEN around ELSE around[1 : place] || [CASE kind WHEN 'corrupt' THEN {corrupted_sql('premise', chr(39) + 'hay:' + chr(39) + ' || id')} ELSE premise END] || around[place + 1 :] END AS doc FROM b)
        SELECT id, CAST(CASE kind WHEN 'drop' THEN 2 WHEN 'corrupt' THEN 0 ELSE label END AS integer) AS label, kind, CAST(len(doc) AS integer) AS paragraphs, array_to_string(doc, chr(10) || chr(10)) AS doc FROM c"""
    return run, expand(oracle, DUCK)


query("haystack", *hay(8, 25, 0.3, 0.6))
query("haystack_simple", *hay(15, 40, 0.3, 0.0))

#: Words of text by context bucket.
BUCKETS = [("4k", 3000), ("8k", 6000), ("16k", 12000), ("32k", 24000), ("64k", 48000), ("128k", 96000)]
FACTS = [("The vault code was changed to 7741 on Friday.", "The code of the vault was changed on Friday.", "The code of the vault was never changed.", "The vault was built in 1950."), ("Dr. Ames signed the report in Oslo.", "The report was signed in Oslo.", "Nobody signed the report.", "The report has ninety pages."), ("Line 4 carried 900 tons in May.", "Line 4 carried tons of freight in May.", "Line 4 stood still in May.", "Line 4 gets new engines.")]
FILLERS = [" ".join(f"{w} {k} notes" for k in range(n)) + "." for w, n in (("Archive", 20), ("Maintenance", 35), ("Weather", 27), ("Transport", 41), ("Harvest", 30))]


def bucketed(d):
    """Documents of a length by bucket, the fact at a drawn depth; 35 % follow, 35 % contradict, 30 % are open (half of these with an unrelated insertion)."""
    n, p = "hays", len(FILLERS)
    words = [len(f.split()) for f in FILLERS]
    cycle = sum(words)
    sums = [(s, m, sum(words[(s + k) % p] for k in range(m))) for s in range(p) for m in range(1, p + 1)]
    fact = lambda k: d.pick([f[k] for f in FACTS], "fact")
    base = layers(
        d, {"bucket": number(d, n, "bucket", 0, len(BUCKETS) - 1), "fact": number(d, n, "fact", 0, len(FACTS) - 1), "roll": number(d, n, "roll", 0, 99), "start": number(d, n, "start", 0, p - 1), "depth": f"({number(d, n, 'depth', 200, 9800)} / 10000e0)", "half": number(d, n, "half", 0, 1)},
        {"target": d.pick([w for _, w in BUCKETS], "bucket"), "name": d.pick([b for b, _ in BUCKETS], "bucket"), "label": "CASE WHEN roll < 35 THEN 1 WHEN roll < 70 THEN 0 ELSE 2 END"},
        {"cycles": f"CAST(floor((target - 1) / {cycle}) AS int)"},
    )
    fillers = d.arr(*map(literal, FILLERS))
    body = d.map(d.upto("n"), "k", d.at(fillers, f"(start + k) % {p}"))
    needle = f"CASE WHEN label < 2 THEN {fact(0)} ELSE 'An unrelated check was logged for routine upkeep.' END"
    return f"""WITH s(first, m, words) AS (VALUES {', '.join(map(str, sums))}), b AS (SELECT * FROM {base} AS x),
        c AS (SELECT b.i, min(b.cycles * {p} + s.m) AS n FROM b JOIN s ON s.first = b.start AND s.words >= b.target - b.cycles * {cycle} GROUP BY b.i),
        e AS (SELECT b.*, c.n, label < 2 OR half = 1 AS inserted, CAST(floor(depth * c.n) AS int) AS at_ FROM b JOIN c ON b.i = c.i),
        f AS (SELECT *, CASE WHEN inserted THEN {d.cat(d.cut(body, '0', 'at_'), d.arr(needle), d.cut(body, 'at_', 'n - at_'))} ELSE {body} END AS doc FROM e)
        SELECT concat('hays_', i) AS id, name AS bucket, label, CASE label WHEN 1 THEN {fact(1)} WHEN 0 THEN {fact(2)} ELSE {fact(3)} END AS hypothesis, concat('haystack_', name, CASE label WHEN 1 THEN '_ent' WHEN 0 THEN '_con' ELSE '_neu' END) AS source, {d.size('doc')} AS paragraphs,
        CASE WHEN label = 2 THEN 'none' WHEN depth < 0.2e0 THEN '0.0-0.2' WHEN depth < 0.4e0 THEN '0.2-0.4' WHEN depth < 0.6e0 THEN '0.4-0.6' WHEN depth < 0.8e0 THEN '0.6-0.8' ELSE '0.8-1.0' END AS depth_bucket, md5({d.joined('doc', 'chr(10)')}) AS doc_md5 FROM f"""


sql("haystack_bucketed", bucketed)

# questions about pictures
VQA = [
    ("Is it red?", "yes", "yes/no", 10), ("is it cold ?", "No", "yes/no", 8), ("How many dogs are there?", "2", "number", 9), ("how many are there?", "7", "number", 10), ("What color is the car?", "Blue ", "other", 7), ("what colour are they", "grey", "other", 10), ("Where is he?", "home", "other", 4),
    ("Does the man smile?", "yes", "yes/no", 10), ("Is this?", "no", "yes/no", 10), ("Can dogs fly?", "no", "yes/no", 3), ("What animal??", "cat", "other", 10), ("Who is she", "Queen", "other", 0), ("how many red cats can you see", "12", "number", 10), ("", "yes", "yes/no", 10),
]
VQA_ROWS = "(VALUES " + ", ".join(f"({i}, {literal(q)}, {literal(a)}, {literal(k)}, {n})" for i, (q, a, k, n) in enumerate(VQA)) + ") AS v(id, question, answer, kind, agree)"


def claim_sql(q, a, kind):
    """The oracle's five rules."""
    low, low_a = f"lower({q})", f"lower(trim({a}))"
    aux = "is|are|was|were|does|do|did|can|has|have|will"
    noun = f"trim(regexp_replace(regexp_extract({low}, '^how many (.+)$', 1), '\\b(are|is|can|do|does|there|in|on|the|this|that|photo|picture|image)\\b.*$', ''))"
    verb, rest = (f"regexp_extract({low}, '^({aux})\\s+(.+)$', {g})" for g in (1, 2))
    return (f"""CASE WHEN regexp_matches({low}, '^what colou?r (is|are) (the )?.+$') THEN 'The ' || regexp_extract({low}, '^what colou?r (?:is|are) (?:the )?(.+)$', 1) || ' is ' || {low_a} || '.'
        WHEN {noun} <> '' THEN 'There are ' || CASE {low_a} WHEN '0' THEN 'no' WHEN '1' THEN 'one' WHEN '2' THEN 'two' WHEN '3' THEN 'three' WHEN '4' THEN 'four' WHEN '5' THEN 'five' ELSE {low_a} END || ' ' || {noun} || ' in the image.'
        WHEN {kind} = 'yes/no' AND {verb} IN ('is', 'are', 'was', 'were') AND instr({rest}, ' ') > 0 THEN upper(substr({rest}, 1, 1)) || substr(split_part({rest}, ' ', 1), 2) || ' ' || {verb} || ' ' || substr({rest}, instr({rest}, ' ') + 1) || '.'
        WHEN {kind} = 'yes/no' AND {verb} <> '' AND {verb} NOT IN ('is', 'are', 'was', 'were') THEN upper(substr({rest}, 1, 1)) || substr({rest}, 2) || ' (' || {verb} || ').'
        WHEN {kind} = 'yes/no' THEN 'The answer to "' || {q} || '?" is ' || {low_a} || '.' ELSE 'In this image, the answer to "' || {q} || '?" is ' || {low_a} || '.' END""",
        f"NOT regexp_matches({low}, '^what colou?r (is|are) (the )?.+$') AND {noun} = '' AND {kind} = 'yes/no' AND {verb} <> '' AND ({verb} NOT IN ('is', 'are', 'was', 'were') OR instr({rest}, ' ') > 0)")


ASKED = f"(SELECT *, trim(rtrim(trim(question), '?')) AS q FROM {VQA_ROWS}) AS w"
CLAIM, TURNS = claim_sql("q", "answer", "kind")
vqa = lambda spark: spark.sql(f"SELECT * FROM {VQA_ROWS}")
query("vqa_statement", lambda spark, sf: vqa(spark).select("id", M.statement(F.col("question"), F.col("answer"), F.col("kind")).alias("s")).select("id", "s.claim", "s.flips"), f"SELECT id, {CLAIM} AS claim, {TURNS} AS flips FROM {ASKED}")


def vqa_rows(spark, sf):
    """Annotators that disagree leave a claim open; yes and no; else the claim follows, and half get a wrong answer that an earlier question of the kind had."""
    d = ranked(vqa(spark), F.lit(0), ["id"], by=["kind"], rank="k").withColumn("s", M.statement(F.col("question"), F.col("answer"), F.col("kind")))
    k = F.concat(F.lit("vqa:"), F.col("id").cast("string"))
    low = F.lower(F.trim("answer"))
    open_, yes_no = F.col("agree").between(1, 5), (F.col("kind") == "yes/no") & F.col("s.flips")
    label = F.when(open_, 2).when(yes_no, F.when(low == "yes", 1).otherwise(0)).otherwise(1)
    source = F.when(open_, "vqa_disagree").when(yes_no, "vqa_yesno").otherwise("vqa_answer")
    told = d.select("id", F.col("s.claim").alias("claim"), label.alias("label"), source.alias("source"))
    wants = d.where(~open_ & ~yes_no & (F.col("k") > 1) & (draw(F.concat(k, F.lit(":neg")), 2) == 0)).withColumn("other", draw(F.concat(k, F.lit(":other")), F.greatest(F.col("k") - 1, F.lit(1))) + 1)
    pool = d.select(F.col("kind").alias("pool_kind"), F.col("k").alias("pool_k"), F.col("answer").alias("wrong"))
    wrong = wants.join(pool, (F.col("kind") == F.col("pool_kind")) & (F.col("other") == F.col("pool_k"))).where(F.lower(F.trim("wrong")) != low)
    wrong = wrong.select("id", M.statement(F.col("question"), F.col("wrong"), F.col("kind"))["claim"].alias("claim"), F.lit(0).alias("label"), F.lit("vqa_answer_neg").alias("source"))
    return told.unionByName(wrong)


OPEN_, YES = "agree BETWEEN 1 AND 5", f"(kind = 'yes/no' AND {TURNS})"
query("vqa_rows", vqa_rows, f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS k FROM {ASKED}),
    told AS (SELECT id, {CLAIM} AS claim, CASE WHEN {OPEN_} THEN 2 WHEN {YES} THEN CASE WHEN lower(trim(answer)) = 'yes' THEN 1 ELSE 0 END ELSE 1 END AS label, CASE WHEN {OPEN_} THEN 'vqa_disagree' WHEN {YES} THEN 'vqa_yesno' ELSE 'vqa_answer' END AS source FROM w),
    wants AS (SELECT *, {DUCK.draw("'vqa:' || id || ':other'", 'greatest(k - 1, 1)')} + 1 AS other FROM w WHERE NOT ({OPEN_}) AND NOT {YES} AND k > 1 AND {DUCK.draw("'vqa:' || id || ':neg'", 2)} = 0),
    wrong AS (SELECT a.id, a.q, a.kind, b.answer AS answer FROM wants a JOIN w b ON a.kind = b.kind AND b.k = a.other WHERE lower(trim(a.answer)) <> lower(trim(b.answer)))
    SELECT * FROM told UNION ALL SELECT id, {CLAIM} AS claim, 0 AS label, 'vqa_answer_neg' AS source FROM wrong""")

# boxes in a picture: places by thirds and by pixels of a frame of 320 x 240, counts, order, what is absent, what cannot be seen
BOXES = "(VALUES (1, 640, 480, 'dog', 0, 10, 100, 90), (1, 640, 480, 'dog', 300, 10, 380, 90), (1, 640, 480, 'tree', 500, 0, 620, 200), (2, 320, 240, 'car', 120, 50, 220, 120), (3, 1000, 500, 'zebra', 700, 0, 990, 400), (3, 1000, 500, 'giraffe', 10, 0, 90, 400), (3, 1000, 500, ' ', 0, 0, 5, 5)) AS b(image, w, h, label, x0, y0, x1, y1)"
WORDS = "CASE {0} WHEN 0 THEN 'no' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' ELSE CAST({0} AS string) END"


def spatial(d):
    base = f"""WITH box AS (SELECT image, label, (x0 + x1) / 2e0 * 320 / w AS cx, row_number() OVER (PARTITION BY image ORDER BY md5(concat('box:', image, ':', label, ':', x0))) AS r FROM {BOXES} WHERE trim(label) <> ''),
        kind AS (SELECT image, label, count(*) AS n, avg(cx) AS cx, row_number() OVER (PARTITION BY image ORDER BY md5(concat('kind:', image, ':', label))) AS r FROM box GROUP BY image, label),
        one AS (SELECT box.image, box.label, box.cx, kind.n, CASE WHEN box.cx < 320 / 3e0 THEN 0 WHEN box.cx > 640 / 3e0 THEN 2 ELSE 1 END AS third, {d.draw("concat('wrong:', box.image)", 2)} AS pick FROM box JOIN kind ON box.image = kind.image AND box.label = kind.label WHERE box.r = 1),
        two AS (SELECT a.image, a.label AS a, b.label AS b, a.cx < b.cx AS before FROM kind a JOIN kind b ON a.image = b.image WHERE a.r = 1 AND b.r = 2),
        absent AS (SELECT image, min(k) AS k FROM (SELECT DISTINCT image FROM box) AS i CROSS JOIN (VALUES (0, 'giraffe'), (1, 'helicopter'), (2, 'piano')) AS c(k, name) WHERE NOT EXISTS (SELECT 1 FROM box x WHERE x.image = i.image AND x.label = c.name) GROUP BY image)"""
    third = lambda t: f"CASE {t} WHEN 0 THEN 'left' WHEN 1 THEN 'middle' ELSE 'right' END"
    n = lambda x: WORDS.format(x)
    rows = [
        ("one", f"concat('There is a ', label, ' in the ', {third('third')}, ' third of the image.')", 1), ("one", f"concat('There is a ', label, ' in the ', {third('(third + 1 + pick) % 3')}, ' third of the image.')", 0),
        ("one", "CASE WHEN cx < 110 THEN concat('The ', label, ' is at x < 110, on the left.') WHEN cx > 210 THEN concat('The ', label, ' is at x > 210, on the right.') ELSE concat('The ', label, ' is near the centre, around x = 160.') END", 1),
        ("one", "CASE WHEN cx < 110 THEN concat('The ', label, ' is at x > 210, on the right.') ELSE concat('The ', label, ' is at x < 110, on the left.') END", 0),
        ("one", f"concat('There are ', {n('n')}, ' ', label, 's in the image.')", 1), ("one", f"concat('There are ', {n('(n + 2)')}, ' ', label, 's in the image.')", 0), ("two", "concat('The ', a, ' is to the ', CASE WHEN before THEN 'left' ELSE 'right' END, ' of the ', b, '.')", 1),
        ("two", "concat('The ', a, ' is to the ', CASE WHEN before THEN 'right' ELSE 'left' END, ' of the ', b, '.')", 0), ("absent", "concat('There is a ', CASE k WHEN 0 THEN 'giraffe' WHEN 1 THEN 'helicopter' ELSE 'piano' END, ' in the image.')", 0), ("one", "concat('The ', label, ' was bought last week.')", 2),
    ]
    return f"{base} " + " UNION ALL ".join(f"SELECT image, {h} AS claim, {y} AS label FROM {t}" for t, h, y in rows)


sql("spatial_claims", spatial)

# fields of documents: orders as invoices
OTHERS = ["Apex Holdings", "Meridian Solutions", "Net-30", "Wire Transfer"]
UNSTATED = ["The payment went through an escrow account.", "The vendor holds a security certificate.", "A surcharge was waived.", "The hardcopy is archived."]


def doc_claims(d):
    """What a field says, the same put wrong (a number scaled, else another entity), and something that isn't stated."""
    k = lambda what: f"concat('doc:', o_orderkey, ':', field, ':{what}')"
    found = d.extract("value", "([0-9]+([.][0-9]+)?)", 1)
    delta = d.pick(["1.15", "0.75", "1.50", "2.00"], d.draw(k("delta"), 4))
    wrong = f"CASE WHEN {found} <> '' THEN CAST(CAST(round(TRY_CAST({found} AS decimal(14, 2)) * CAST({delta} AS decimal(4, 2)), 2) AS decimal(18, 2)) AS string) ELSE {d.pick(OTHERS, d.draw(k('other'), 4))} END"
    fields = " UNION ALL ".join(f"SELECT o_orderkey, '{f}' AS field, {v} AS value FROM orders" for f, v in (("total", "concat('$', CAST(CAST(o_totalprice AS decimal(18, 2)) AS string))"), ("status", "o_orderstatus"), ("priority", "o_orderpriority")))
    return f"""WITH f AS ({fields}), g AS (SELECT *, {wrong} AS wrong, {d.pick(UNSTATED, d.draw(k('open'), 4))} AS open_ FROM f)
        SELECT o_orderkey, field, label, CASE label WHEN 1 THEN concat('According to the invoice, the ', field, ' is ', value, '.') WHEN 0 THEN concat('According to the invoice, the ', field, ' is ', wrong, '.') ELSE open_ END AS claim FROM g CROSS JOIN (VALUES (1), (0), (2)) AS v(label)"""


sql("doc_claims", doc_claims)

# drawn scenes, charts and tables with facts, and each fact put wrong
COLOURS, SHAPES = ["red", "blue", "green", "yellow", "purple", "orange"], ["circle", "square", "triangle"]


def scene(d):
    o = lambda what, m: d.draw(f"concat('scene:', i, ':', j, ':{what}')", m)
    base = f"""WITH s AS (SELECT i, 3 + {d.draw("concat('scene:', i, ':n')", 4)} AS n FROM {d.seq(N)} AS q), o AS (SELECT i, j, n, {d.pick(COLOURS, o('colour', 6))} AS colour, {d.pick(SHAPES, o('shape', 3))} AS shape, {o('cx', 300)} AS cx, 100 + {o('area', 900)} AS area FROM s JOIN {d.seq(6, 'j')} AS t ON j < n),
        r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY md5(concat('pick:', i, ':', j))) AS k, row_number() OVER (PARTITION BY i ORDER BY area DESC, j) AS big, count(*) OVER (PARTITION BY i, colour) AS same FROM o),
        a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM r WHERE k = 2), g AS (SELECT * FROM r WHERE big = 1), h AS (SELECT * FROM r WHERE big = 2),
        m AS (SELECT i, min(c) AS c FROM s CROSS JOIN (VALUES {', '.join(f'({k}, {literal(c)})' for k, c in enumerate(COLOURS))}) AS v(c, name) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.i = s.i AND o.colour = v.name) GROUP BY i)"""
    region = "CASE WHEN cx < 100 THEN 'left' WHEN cx < 200 THEN 'middle' ELSE 'right' END"
    other = d.pick(COLOURS, f"({' + '.join(f'CASE WHEN colour = {literal(c)} THEN {k} ELSE 0 END' for k, c in enumerate(COLOURS))} + 1) % 6")
    wrong = d.pick([-2, -1, 1, 2], d.draw("concat('scene:', i, ':wrong')", 4))
    said = [
        ("s", "concat('There are exactly ', n, ' shapes.')", 1), ("s", f"concat('There are exactly ', greatest(1, n + {wrong}), ' shapes.')", 0), ("a", f"concat('A ', colour, ' ', shape, ' is on the ', {region}, '.')", 1), ("a", f"concat('A ', {other}, ' ', shape, ' is on the ', {region}, '.')", 0),
        ("m", f"concat('No shape is ', {d.pick(COLOURS, 'c')}, '.')", 1), ("m", f"concat('A shape is ', {d.pick(COLOURS, 'c')}, '.')", 0), ("g", "concat('The largest shape is ', colour, '.')", 1), ("(SELECT h.* FROM h JOIN g ON g.i = h.i WHERE g.colour <> h.colour) AS h2", "concat('The largest shape is ', colour, '.')", 0),
        ("a", "concat(same, ' shapes are ', colour, '.')", 1), ("a", "concat(same + 1, ' shapes are ', colour, '.')", 0), ("(SELECT a.i, a.colour, a.shape, a.cx, b.colour AS colour2, b.shape AS shape2, b.cx AS cx2 FROM a JOIN b ON a.i = b.i WHERE a.cx <> b.cx) AS p", "concat('A ', colour, ' ', shape, ' is ', CASE WHEN cx < cx2 THEN 'left' ELSE 'right' END, ' of a ', colour2, ' ', shape2, '.')", 1),
        ("s", "'The shapes were arranged last week.'", 2),
    ]
    return f"{base} " + " UNION ALL ".join(f"SELECT i, {c} AS claim, {y} AS label FROM {t}" for t, c, y in said)


QUARTERS = ["Q1", "Q2", "Q3", "Q4"]


def chart(d):
    base = f"""WITH v AS (SELECT i, j, 10 + {d.draw("concat('chart:', i, ':', j)", 90)} AS x, {d.pick(QUARTERS, 'j')} AS q FROM {d.seq(N)} AS s CROSS JOIN {d.seq(4, 'j')} AS t), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY md5(concat('c:', i, ':', j))) AS k, row_number() OVER (PARTITION BY i ORDER BY x DESC, j) AS top FROM v),
        a AS (SELECT * FROM r WHERE k = 1), p AS (SELECT x.i, x.q AS hi, y.q AS lo FROM r x JOIN r y ON x.i = y.i WHERE x.k <= 2 AND y.k <= 2 AND x.k <> y.k AND x.x > y.x), t1 AS (SELECT * FROM r WHERE top = 1), t2 AS (SELECT r.* FROM r JOIN t1 ON r.i = t1.i WHERE r.top = 2 AND r.x < t1.x)"""
    more = d.pick([3, 7, 12], d.draw("concat('chart:', i, ':more')", 3))
    said = [("a", "concat('The ', q, ' value is ', x, '.')", 1), ("a", f"concat('The ', q, ' value is ', x + {more}, '.')", 0), ("p", "concat(hi, ' is higher than ', lo, '.')", 1), ("p", "concat(lo, ' is higher than ', hi, '.')", 0), ("t1", "concat(q, ' is the highest.')", 1), ("t2", "concat(q, ' is the highest.')", 0), ("a", "'The team was content with the chart.'", 2)]
    return f"{base} " + " UNION ALL ".join(f"SELECT i, {c} AS claim, {y} AS label FROM {t}" for t, c, y in said)


ITEMS = ["Widget", "Gadget", "Bracket", "Panel", "Coil", "Sensor", "Valve"]


def table(d):
    base = f"""WITH v AS (SELECT i, j, {d.pick(ITEMS, f"({d.draw(key('table', 'start'), 7)} + j * (1 + {d.draw(key('table', 'step'), 6)})) % 7")} AS item, 2 + {d.draw("concat('table:', i, ':q:', j)", 11)} AS qty FROM {d.seq(N)} AS s CROSS JOIN {d.seq(3, 'j')} AS t),
        a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY md5(concat('t:', i, ':', j))) AS k FROM v) AS w WHERE k = 1), c AS (SELECT i, count(*) AS n FROM v GROUP BY i)"""
    said = [("a", "concat(item, ' has a quantity of ', qty, '.')", 1), ("a", f"concat(item, ' has a quantity of ', qty + {d.pick([1, 3, 5], d.draw(key('table', 'more'), 3))}, '.')", 0), ("c", "concat('The table has ', n, ' rows.')", 1), ("c", f"concat('The table has ', n + 1 + {d.draw(key('table', 'rows'), 2)}, ' rows.')", 0), ("a", "'The order was placed by the buyers.'", 2)]
    return f"{base} " + " UNION ALL ".join(f"SELECT i, {c} AS claim, {y} AS label FROM {t}" for t, c, y in said)


sql("scene_claims", scene)
sql("chart_claims", chart)
sql("table_claims", table)

# what an agent holds and is near: at least so many, none, near, unknown
THINGS, PLACES = ["oak log", "stick", "coal", "torch", "apple", "bucket", "furnace", "raw iron"], ["a chest", "water", "lava", "a furnace"]


def states(d):
    n = "state"
    held = {f"t{k}": f"CASE WHEN {d.draw(key(n, f'has{k}'), 2)} = 0 THEN 1 + {d.draw(key(n, f'n{k}'), 40)} ELSE 0 END" for k in range(len(THINGS))}
    near = {f"p{k}": f"{d.draw(key(n, f'near{k}'), 3)} = 0" for k in range(len(PLACES))}
    base = layers(d, held | near | {"kind": number(d, n, "kind", 0, 3), "thing": number(d, n, "thing", 0, len(THINGS) - 1), "spot": number(d, n, "spot", 0, len(PLACES) - 1), "least_": number(d, n, "least", 1, 20), "health": number(d, n, "health", 1, 20)},
                  {"have": d.at(d.arr(*held), "thing"), "close": d.at(d.arr(*near), "spot"), "name": d.pick(THINGS, "thing"), "place": d.pick(PLACES, "spot")})
    lines = "concat_ws(', ', " + ", ".join(f"CASE WHEN t{k} > 0 THEN concat({literal(x)}, ': ', t{k}) END" for k, x in enumerate(THINGS)) + ")"
    spots = "concat_ws(', ', " + ", ".join(f"CASE WHEN p{k} THEN {literal(x)} END" for k, x in enumerate(PLACES)) + ")"
    return f"""SELECT i, concat('Inventory: ', coalesce(nullif({lines}, ''), '(empty)'), '. Nearby: ', coalesce(nullif({spots}, ''), 'nothing'), '. Health: ', health, '/20') AS premise,
        CASE kind WHEN 0 THEN concat('There are ', least_, ' ', name, ' or more.') WHEN 1 THEN concat('There are no ', name, '.') WHEN 2 THEN concat('The agent is near ', place, '.') ELSE {choice(d, n, 'open', ['The agent has played for an hour.', 'The agent wants to build a shelter.', 'Another player made the torch.'])} END AS claim,
        CASE kind WHEN 0 THEN CASE WHEN have >= least_ THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN have = 0 THEN 1 ELSE 0 END WHEN 2 THEN CASE WHEN close THEN 1 ELSE 0 END ELSE 2 END AS label FROM {base} AS q"""


sql("state_predicates", states)

# tool calls: the call, another name, a changed argument, one left out, what cannot be known
CALLS = [
    {"query": " Weather in Rome? ", "tools": "[weather]", "answers": [{"name": "weather", "arguments": {"city": "Rome", "days": 3}}]}, {"query": "Mail Ann", "tools": "[mail]", "answers": json.dumps([{"name": "mail", "arguments": {"to": "Ann"}}, {"name": "log", "arguments": {}}])}, {"query": "Ping", "tools": "[ping]", "answers": [{"name": "ping", "arguments": {}}]},
    {"query": "Nothing", "answers": []}, {"query": "No name", "answers": [{"arguments": {"a": 1}}]}, {"query": "Flag", "tools": "[set]", "answers": [{"name": "set", "arguments": {"on": True, "level": 2.5}}]}, {"query": "Broken", "answers": "[{"},
]
CALL_ROWS = [(i, json.dumps(c)) for i, c in enumerate(CALLS)]


def agentic(spark, sf):
    d = spark.createDataFrame(CALL_ROWS, "id int, record string")
    get = lambda p, c="record": F.get_json_object(c, p)
    d = d.select("id", F.trim(get("$.query")).alias("query"), F.coalesce(get("$.tools"), F.lit("null")).alias("tools"), get("$.answers").alias("calls"))
    names = d.select(F.explode(F.filter(F.array(*(get(f"$[{k}].name", "calls") for k in range(2))), lambda x: x.isNotNull())).alias("name"), "id")
    names = ranked(names.withColumn("h", F.md5(F.concat("name", F.lit(":"), F.col("id").cast("string")))), F.substring("h", 1, 3), ["h"], rank="k", size="n").select("name", "k", "n")
    d = d.withColumn("name", get("$[0].name", "calls")).withColumn("args", F.from_json(F.coalesce(get("$[0].arguments", "calls"), F.lit("{}")), "map<string, variant>")).where("name <> ''")
    k = F.concat(F.lit("call:"), F.col("id").cast("string"))
    d = d.withColumn("entries", F.transform(F.map_entries("args"), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))
    d = d.withColumn("at", draw(F.concat(k, F.lit(":arg")), F.greatest(F.size("entries"), F.lit(1)))).crossJoin(F.broadcast(names.agg(F.max("n").alias("all_names")))).withColumn("pick", draw(F.concat(k, F.lit(":name")), F.col("all_names")) + 1)
    d = d.join(names.select(F.col("name").alias("bad"), F.col("k").alias("pick")), "pick", "left").withColumn("changed", F.get("entries", F.col("at")))
    call = lambda name, entries: F.concat(F.lit("The correct call is "), name, F.lit("("), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit(")."))
    value = F.col("changed.value")
    number_ = value.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    mutated = F.when(number_ & ~value.contains("."), (value.try_cast("long") + 7).cast("string")).when(number_, (value.try_cast("double") + 7).cast("string")).otherwise(F.concat(F.lit('"'), F.when(value.startswith('"'), F.regexp_replace(value, '^"|"$', "")).when(value == "true", "True").when(value == "false", "False").otherwise(value), F.lit('_x"')))
    put = F.transform("entries", lambda e, i: F.when(i == F.col("at"), F.struct(e["key"].alias("key"), F.col("mutated").alias("value"))).otherwise(e))
    rest = F.filter("entries", lambda e: e["key"] != F.col("changed.key"))
    has = F.size("entries") > 0
    d = d.withColumn("mutated", mutated)
    rows = F.array(
        F.struct(call(F.col("name"), F.col("entries")).alias("claim"), F.lit(1).alias("label"), F.lit("xlam").alias("source"), F.lit(True).alias("ok")), F.struct(call(F.col("bad"), F.col("entries")).alias("claim"), F.lit(0).alias("label"), F.lit("xlam_neg_name").alias("source"), (F.col("bad") != F.col("name")).alias("ok")),
        F.struct(call(F.col("name"), put).alias("claim"), F.lit(0).alias("label"), F.lit("xlam_neg_arg").alias("source"), has.alias("ok")), F.struct(F.concat(F.lit("The value of `"), F.col("changed.key"), F.lit("` cannot be determined from the user request.")).alias("claim"), F.when(F.size("entries") > 1, 2).otherwise(0).alias("label"), F.lit("xlam_underspec").alias("source"), has.alias("ok")),
        F.struct(call(F.col("name"), rest).alias("claim"), F.lit(0).alias("label"), F.lit("xlam_neg_missing").alias("source"), (F.size("entries") > 1).alias("ok")),
    )
    return d.select("id", F.concat(F.lit("User request: "), "query", F.lit("\nAvailable tools: "), F.substring("tools", 1, 1200)).alias("premise"), F.explode(F.filter(rows, lambda r: r["ok"])).alias("r")).select("id", "premise", "r.claim", "r.label", "r.source")


CALLED = "(VALUES " + ", ".join(f"({i}, {literal(r)})" for i, r in CALL_ROWS) + ") AS v(id, j)"
JOINED = "'(' || array_to_string(list_transform({0}, lambda e: e.k || '=' || e.v), ', ') || ').'"
query("agentic_calls", agentic, f"""WITH a AS (SELECT id, trim(json_extract_string(j, '$.query')) AS query, coalesce(json_extract_string(j, '$.tools'), 'null') AS tools, json_extract_string(j, '$.answers') AS calls FROM {CALLED}), b AS (SELECT * FROM a WHERE json_valid(calls)),
    nm AS (SELECT name, row_number() OVER (ORDER BY md5(name || ':' || id)) AS k FROM (SELECT id, unnest([json_extract_string(calls, '$[0].name'), json_extract_string(calls, '$[1].name')]) AS name FROM b) AS u WHERE name IS NOT NULL),
    c AS (SELECT id, query, tools, json_extract_string(calls, '$[0].name') AS name, coalesce(json_extract(calls, '$[0].arguments'), '{{}}') AS args FROM b WHERE json_extract_string(calls, '$[0].name') <> ''),
    e AS (SELECT *, list_transform(json_keys(args), lambda x: {{'k': x, 'v': CAST(json_extract(args, '$.' || x) AS varchar), 't': json_type(args, '$.' || x)}}) AS entries FROM c), f AS (SELECT *, {DUCK.draw("'call:' || id || ':arg'", 'greatest(len(entries), 1)')} + 1 AS at_, {DUCK.draw("'call:' || id || ':name'", '(SELECT count(*) FROM nm)')} + 1 AS pick FROM e),
    g AS (SELECT f.*, nm.name AS bad, entries[at_] AS ch FROM f LEFT JOIN nm ON nm.k = f.pick),
    h AS (SELECT *, CASE WHEN ch.t IN ('UBIGINT', 'BIGINT') THEN CAST(CAST(ch.v AS bigint) + 7 AS varchar) WHEN ch.t = 'DOUBLE' THEN CAST(CAST(ch.v AS double) + 7 AS varchar) WHEN ch.t = 'BOOLEAN' THEN '"' || upper(substr(ch.v, 1, 1)) || substr(ch.v, 2) || '_x"' ELSE '"' || trim(ch.v, '"') || '_x"' END AS mutated, 'User request: ' || query || chr(10) || 'Available tools: ' || substr(tools, 1, 1200) AS premise FROM g)
    SELECT id, premise, 'The correct call is ' || name || {JOINED.format('entries')} AS claim, 1 AS label, 'xlam' AS source FROM h
    UNION ALL SELECT id, premise, 'The correct call is ' || bad || {JOINED.format('entries')} AS claim, 0 AS label, 'xlam_neg_name' AS source FROM h WHERE bad <> name
    UNION ALL SELECT id, premise, 'The correct call is ' || name || {JOINED.format("list_transform(entries, lambda e: {'k': e.k, 'v': CASE WHEN e.k = ch.k THEN mutated ELSE e.v END})")} AS claim, 0 AS label, 'xlam_neg_arg' AS source FROM h WHERE len(entries) > 0
    UNION ALL SELECT id, premise, 'The value of `' || ch.k || '` cannot be determined from the user request.' AS claim, CASE WHEN len(entries) > 1 THEN 2 ELSE 0 END AS label, 'xlam_underspec' AS source FROM h WHERE len(entries) > 0
    UNION ALL SELECT id, premise, 'The correct call is ' || name || {JOINED.format("list_filter(entries, lambda e: e.k <> ch.k)")} AS claim, 0 AS label, 'xlam_neg_missing' AS source FROM h WHERE len(entries) > 1""")


def trajectories(d):
    """Two turns of an assistant a conversation, with the two turns before: the action that followed, and one drawn from all."""
    return f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text, 1) OVER w AS a, lag(text, 2) OVER w AS b, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
        c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat('traj:', conv_id, ':', turn))) AS k FROM t WHERE role = 'assistant' AND n > 1),
        p AS (SELECT conv_id, turn, right(concat(CASE WHEN b IS NULL THEN '' ELSE concat(b, chr(10)) END, coalesce(a, '')), 1500) AS context, substr(text, 1, 400) AS action, {d.draw("concat('other:', conv_id, ':', turn)", '(SELECT count(*) FROM ranked_actions)')} + 1 AS pick FROM c WHERE k <= 2)
        SELECT conv_id, turn, context, concat('The next action is: ', action) AS claim, 1 AS label FROM p
        UNION ALL SELECT p.conv_id, p.turn, p.context, concat('The next action is: ', o.action) AS claim, 0 AS label FROM p JOIN ranked_actions o ON p.pick = o.k WHERE o.action <> p.action"""


rank_relation("ranked_actions", lambda d: "SELECT substr(text, 1, 400) AS action, md5(concat('act:', conv_id, ':', turn)) AS h FROM conversations WHERE role = 'assistant' AND text <> ''", "h")
sql("trajectory_pairs", trajectories)
sql("episode_encode", lambda d: f"""WITH c AS (SELECT conv_id, {d.listed('text', 'turn')} AS turns, count(*) AS n FROM conversations GROUP BY conv_id), p AS (SELECT DISTINCT conv_id, CASE WHEN n <= 4 THEN i + 1 ELSE CAST(round(1 + i * (n - 1) / 3e0) AS bigint) END AS prefix FROM c CROSS JOIN {d.seq(4)} AS r WHERE i < n)
    SELECT p.conv_id, p.prefix, round(p.prefix / CAST(c.n AS double), 6) AS part, {d.joined(d.cut('c.turns', '0', 'p.prefix'), 'chr(10)')} AS conversation FROM p JOIN c ON p.conv_id = c.conv_id""")

# records of a suite: premise and hypothesis in one text, an answer by letter or by name
SERVED = "concat('Premise: ', premise, chr(10), 'Hypothesis: ', hypothesis)"
SUITE = f"(SELECT id, premise, label, CASE WHEN id % 10 = 7 THEN premise ELSE {SERVED} END AS text FROM pair) AS s"
sql("parse_premise_hyp", lambda d: f"SELECT id, trim({d.span('text', '^Premise: (.*?)Hypothesis: (.*)', 1)}) AS premise, trim({d.span('text', '^Premise: (.*?)Hypothesis: (.*)', 2)}) AS hypothesis FROM {SUITE} WHERE text LIKE 'Premise: %Hypothesis: %'")


def anli(d):
    """Lines of the instructions that begin with Premise: and Hypothesis:, the first of each; the letters A, B, C; others give no row."""
    record = d.object(instructions="text", gold="CASE label WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 0 THEN CASE WHEN id % 10 = 3 THEN 'X' ELSE 'C' END END")
    line = lambda what: d.extract("t", f"(^|\n){what}: ([^\n]*)", 2)
    return f"""SELECT id, {line('Premise')} AS premise, {line('Hypothesis')} AS hypothesis, CASE g WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 0 END AS label, 'hard' AS slice FROM (SELECT id, {d.json('j', 'instructions')} AS t, {d.json('j', 'gold')} AS g FROM (SELECT id, {record} AS j FROM {SUITE}) AS a) AS b
        WHERE g IN ('A', 'B', 'C') AND {d.matches('t', '(^|' + chr(10) + ')Premise: ')} AND {d.matches('t', '(^|' + chr(10) + ')Hypothesis: ')}"""


def contract(d):
    """Premises of 200 characters at least; what stands after the marker, whatever its case; three names; others give no row."""
    record = d.object(state="premise", instructions="concat('Judge the HYPOTHESIS: ', substr(text, 1, 80))", expected="CASE label WHEN 1 THEN 'Entailment' WHEN 0 THEN 'Contradiction' ELSE CASE WHEN id % 2 = 0 THEN 'NotMentioned' ELSE 'Unknown' END END")
    return f"""SELECT id, s AS premise, trim(substr(t, instr(lower(t), 'hypothesis:') + 11)) AS hypothesis, CASE e WHEN 'Entailment' THEN 1 WHEN 'Contradiction' THEN 0 ELSE 2 END AS label FROM (SELECT id, {d.json('j', 'state')} AS s, {d.json('j', 'instructions')} AS t, {d.json('j', 'expected')} AS e FROM (SELECT id, {record} AS j FROM {SUITE}) AS a) AS b
        WHERE length(s) >= 200 AND instr(lower(t), 'hypothesis:') > 0 AND e IN ('Entailment', 'Contradiction', 'NotMentioned')"""


sql("suite_anli", anli)
sql("suite_contractnli", contract)
#: Fixed value: the claim that is served.
UNSUPPORTED = "The response contains content that is not supported by the context in the prompt."
sql("ragtruth_served", lambda d: f"SELECT id, concat('Prompt: ', p, chr(10), chr(10), 'Response: ', r) AS premise, '{UNSUPPORTED}' AS hypothesis, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM (SELECT id, label, trim({d.span('text', '^Premise: (.*?)Hypothesis: (.*)', 1)}) AS p, trim({d.span('text', '^Premise: (.*?)Hypothesis: (.*)', 2)}) AS r FROM {SUITE} WHERE label < 2 AND text LIKE 'Premise: %Hypothesis: %') AS a")
