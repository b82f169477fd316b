"""Typed cases, graded pairs and decisions of the second format, made of the lines of orders: a line is an option, the dearest the right one."""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gavelflow.operators import records as R
from gavelflow.operators import typed as T
from gavelflow.operators.salvage import salvaged
from .base import DUCK, SPARK, expand, literal, query, spark_sql, sql
from .records import SLOTS, order_decisions

# cases: each order asks for its dearest part (choice) and how many lines it has (score), each line whether it is that part (noul)
CLAMP = "greatest(0e0, least(1e0, soft * 10))"


def _cases(spark, sf):
    d = spark_sql(spark, sf, expand("SELECT group_id, ord, part, score, soft, is_gold FROM grouped", SPARK))
    object_ = lambda **f: F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))
    question = lambda kind, text, criteria: F.struct(F.lit(kind).alias("type"), F.lit(text).alias("instructions"), criteria.alias("criteria"))
    line = d.select(
        F.concat_ws("-", "group_id", "ord", "part").alias("state_id"), F.lit("orders").alias("domain"), F.concat(F.lit("Part "), "part", F.lit(" of order "), "group_id").alias("state"), object_(q=question("noul", "Is it the dearest?", F.struct(F.lit("It is.").alias("true")))).alias("questions"),
        object_(q=F.col("is_gold") == 1).alias("gold"), F.when(F.col("soft") > 0.02, object_(q=F.struct((F.col("soft") * 10).alias("noul")))).otherwise("{}").alias("teacher"), "group_id",
    )
    g = d.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ord", "part", "score", "soft", "is_gold"))).alias("o"))
    g = g.withColumn("o", F.transform("o", lambda x, i: F.struct(F.concat(i.cast("string"), F.lit("-"), x["part"].cast("string")).alias("key"), x["part"].cast("string").alias("part"), x["soft"].cast("double").alias("soft"), x["is_gold"].alias("is_gold"))))
    parts = F.map_from_entries(F.transform("o", lambda x: F.struct(x["key"], F.concat(F.lit("part "), x["part"]))))
    known = F.map_from_entries(F.transform(F.filter("o", lambda x: x["soft"] > 0.05), lambda x: F.struct(x["key"], x["soft"])))
    best = F.get(F.filter("o", lambda x: x["is_gold"] == 1), F.lit(0))
    order = g.select(
        F.col("group_id").cast("string").alias("state_id"), F.lit("orders").alias("domain"), F.concat(F.lit("Order "), "group_id").alias("state"),
        object_(c=question("choice", "Which is the dearest?", parts), s=question("score", "How many lines?", F.array(*(F.lit(f"{k} lines") for k in range(8)))), n=question("noul", " ", F.lit("x"))).alias("questions"),
        object_(c=best["key"], s=F.size("o"), n=F.lit(True)).alias("gold"), object_(c=F.struct(known.alias("probabilities"))).alias("teacher"), "group_id",
    )
    return line, order


def typed(kind, grouped):
    def run(spark, sf):
        line, order = _cases(spark, sf)
        cases = line if kind == "noul" else order
        out = getattr(T, kind)(T.questions(cases.drop("group_id")), grouped)
        return _flat(out)

    return run


def _flat(d):
    return d.select("state_id", "option", "premise", "hypothesis", "label", "is_gold", F.round("soft_target", 4).alias("soft_target"), F.element_at("soft_labels", 1).alias("s0"), F.element_at("soft_labels", 2).alias("s1"), "source")


LINES = expand("SELECT group_id, ord, part, soft, is_gold, row_number() OVER (PARTITION BY group_id ORDER BY ord, part, score) - 1 AS slot, concat_ws('-', group_id, ord, part) AS sid FROM grouped", DUCK)
hash_of = lambda key, what, n: DUCK.draw(f"{key} || ':{what}'", n)
premise_of = lambda key, asked, state: f"CASE WHEN {hash_of(key, 'premise', 10)} < 8 THEN '{asked}' || chr(10) || chr(10) || {state} ELSE 'Domain: orders' || chr(10) || 'Context:' || chr(10) || {state} || chr(10) || 'Question: {asked}' END"
LINE = f"(SELECT *, sid || ':q' AS k, CASE WHEN soft > 0.02 THEN greatest(0, least(1, soft * 10)) ELSE is_gold END AS p, {premise_of('(sid || ' + chr(39) + ':q' + chr(39) + ')', 'Is it the dearest?', chr(39) + 'Part ' + chr(39) + ' || part || ' + chr(39) + ' of order ' + chr(39) + ' || group_id')} AS premise FROM ({LINES}) AS l) AS a"
tail = lambda p: f"round({p}, 4) AS soft_target"
query("typed_noul", typed("noul", True), f"""SELECT sid AS state_id, 'yes' AS option, premise, CASE WHEN {hash_of('k', 'yes', 10)} < 6 THEN 'The correct answer is: yes: It is.' ELSE 'Confirmed: Is it the dearest?' END AS hypothesis, is_gold AS label, is_gold = 1 AS is_gold, {tail('p')}, round(1 - p, 4) AS s0, round(p, 4) AS s1, 'noul_grouped' AS source FROM {LINE}
    UNION ALL SELECT sid AS state_id, 'no' AS option, premise, CASE WHEN {hash_of('k', 'no', 10)} < 6 THEN 'The correct answer is: no: No' ELSE 'Verification claim (Negative): NOT (Is it the dearest?)' END AS hypothesis, 1 - is_gold AS label, is_gold = 0 AS is_gold, {tail('1 - p')}, round(p, 4) AS s0, round(1 - p, 4) AS s1, 'noul_grouped' AS source FROM {LINE}""")
query("typed_noul_pointwise", typed("noul", False), f"""SELECT sid AS state_id, 'yes' AS option, premise, 'The correct answer is: yes: It is.' AS hypothesis, is_gold AS label, true AS is_gold, {tail('CASE is_gold WHEN 1 THEN p ELSE 1 - p END')}, round(1 - p, 4) AS s0, round(p, 4) AS s1, 'noul' AS source FROM {LINE}
    UNION ALL SELECT sid AS state_id, 'inverted' AS option, premise, 'Verification claim (Negative): NOT (Is it the dearest?)' AS hypothesis, 1 - is_gold AS label, false AS is_gold, {tail('CASE is_gold WHEN 1 THEN 1 - p ELSE p END')}, round(p, 4) AS s0, round(1 - p, 4) AS s1, 'noul_inverted' AS source FROM {LINE} WHERE {hash_of('k', 'inverted', 2)} = 0""")
ORDER = f"(SELECT *, group_id || '' AS sid, slot || '-' || part AS o, count(*) OVER (PARTITION BY group_id) AS kk, {premise_of('(group_id || ' + chr(39) + ':c' + chr(39) + ')', 'Which is the dearest?', chr(39) + 'Order ' + chr(39) + ' || group_id')} AS premise FROM ({LINES}) AS l)"
ORDER = ORDER.replace("SELECT *, group_id || '' AS sid", "SELECT * EXCLUDE (sid), group_id || '' AS sid")
query("typed_choice", typed("choice", True), f"SELECT sid AS state_id, o AS option, premise, 'The correct answer is: ' || o || ': part ' || part AS hypothesis, is_gold AS label, is_gold = 1 AS is_gold, {tail('p')}, round(1 - p, 4) AS s0, round(p, 4) AS s1, 'choice_grouped' AS source FROM (SELECT *, CASE WHEN soft > 0.05 THEN soft WHEN is_gold = 1 THEN 0.95 ELSE 0.05e0 / greatest(1, kk - 1) END AS p FROM {ORDER} AS a) AS b")
query("typed_choice_pointwise", typed("choice", False), f"SELECT sid AS state_id, o AS option, premise, 'The correct answer is: ' || o || ': part ' || part AS hypothesis, is_gold AS label, is_gold = 1 AS is_gold, {tail('p')}, round(1 - p, 4) AS s0, round(p, 4) AS s1, 'choice' AS source FROM (SELECT *, CASE WHEN soft > 0.05 THEN soft WHEN is_gold = 1 THEN 0.95 ELSE 0.05 END AS p, row_number() OVER (PARTITION BY sid, is_gold ORDER BY CASE WHEN soft > 0.05 THEN soft ELSE 0 END DESC, slot) AS r FROM {ORDER} AS a) AS b WHERE is_gold = 1 OR r <= 2")
SCORED = f"(SELECT DISTINCT sid, group_id, kk, {premise_of('(group_id || ' + chr(39) + ':s' + chr(39) + ')', 'How many lines?', chr(39) + 'Order ' + chr(39) + ' || group_id')} AS premise FROM {ORDER} AS a) AS b, range(8) AS r(i)"
query("typed_score", typed("score", True), f"SELECT sid AS state_id, i || '' AS option, premise, 'The correct answer is: ' || i || ': ' || i || ' lines' AS hypothesis, CAST(i = kk AS integer) AS label, i = kk AS is_gold, {tail('CASE WHEN i = kk THEN 0.9 ELSE 0.1e0 / 7 END')}, round(1 - CASE WHEN i = kk THEN 0.9 ELSE 0.1e0 / 7 END, 4) AS s0, round(CASE WHEN i = kk THEN 0.9 ELSE 0.1e0 / 7 END, 4) AS s1, 'score_grouped' AS source FROM {SCORED} WHERE kk < 8")
query("typed_score_pointwise", typed("score", False), f"SELECT sid AS state_id, i || '' AS option, premise, 'The correct answer is: ' || i || ': ' || i || ' lines' AS hypothesis, CAST(i = kk AS integer) AS label, i = kk AS is_gold, CASE WHEN i = kk THEN 0.9 ELSE 0.05 END AS soft_target, CASE WHEN i = kk THEN 0.1 ELSE 0.95 END AS s0, CASE WHEN i = kk THEN 0.9 ELSE 0.05 END AS s1, 'score' AS source FROM {SCORED} WHERE kk < 8 AND (i = kk OR i = CASE WHEN kk = 0 OR (kk < 7 AND {hash_of('(group_id || ' + chr(39) + ':s' + chr(39) + ')', 'alt', 2)} = 0) THEN kk + 1 ELSE kk - 1 END)")
query(
    "typed_ingest", lambda spark, sf: (lambda line, order: T.ingest(order.drop("group_id")).groupBy(F.col("state_id").cast("long").alias("group_id")).agg(F.count(F.lit(1)).alias("rows_"), F.sum("label").alias("right_")))(*_cases(spark, sf)),
    f"SELECT group_id, count(*) + CASE WHEN count(*) < 8 THEN 8 ELSE 0 END AS rows_, 1 + CASE WHEN count(*) < 8 THEN 1 ELSE 0 END AS right_ FROM ({LINES}) AS l GROUP BY group_id",
)


# graded pairs: how sure the right option and the others are
#: The numbers in the two queries below are fixed values.
def graded(right, labels_right, labels_wrong, source):
    def run(spark, sf):
        d = order_decisions(spark, sf).where("size(options) > 1")
        d = d.select(F.col("id").cast("long").alias("group_id"), "gold_index", F.size("options").alias("k"), F.posexplode("options").alias("slot", "o"))
        gold = F.col("slot") == F.col("gold_index")
        soft = F.when(gold, F.lit(right)).otherwise(F.round((1 - right) / (F.col("k") - 1), 4))
        s = [F.when(gold, F.lit(labels_right[j])).otherwise(labels_wrong(soft)[j]) for j in range(3)]
        return d.select("group_id", "o.key", F.concat(F.lit("The correct answer is: "), "o.key", F.lit(": "), "o.text").alias("hypothesis"), gold.cast("int").alias("label"), soft.alias("soft"), *(F.round(x, 4).alias(f"s{j}") for j, x in enumerate(s)), F.lit(source).alias("source"))

    return run


def graded_sql(right, labels_right, labels_wrong, source):
    p = f"CASE WHEN is_gold = 1 THEN {right}e0 ELSE round({1 - right:.2f}e0 / (kk - 1), 4) END"
    return f"SELECT group_id, chr(CAST(65 + slot AS integer)) AS key, 'The correct answer is: ' || chr(CAST(65 + slot AS integer)) || ': ' || part AS hypothesis, is_gold AS label, {p} AS soft, {', '.join(f'round(CASE WHEN is_gold = 1 THEN {a}e0 ELSE {b.format(p=p)} END, 4) AS s{j}' for j, (a, b) in enumerate(zip(labels_right, labels_wrong)))}, '{source}' AS source FROM ({SLOTS}) AS a WHERE kk > 1"


query("scenario_pairs", graded(0.88, (0.05, 0.88, 0.07), lambda p: (0.88 - p, p, F.lit(0.07)), "synth_hard"), graded_sql(0.88, (0.05, 0.88, 0.07), ("0.88e0 - {p}", "{p}", "0.07e0"), "synth_hard"))
query("remediation_pairs", graded(0.92, (0.03, 0.94, 0.03), lambda p: (F.lit(0.92), F.lit(0.03), F.lit(0.05)), "synth_remed"), graded_sql(0.92, (0.03, 0.94, 0.03), ("0.92e0", "0.03e0", "0.05e0"), "synth_remed"))


# decisions of the second format: options under codes in a drawn order, the right code, normalised probabilities
def order_v2(spark, sf):
    """Groups of 2 to 255 options; the order of a group's options is by hash."""
    d = order_decisions(spark, sf).where("size(options) BETWEEN 2 AND 255")
    one = F.transform("options", lambda o, i: F.struct(F.md5(F.concat("id", F.lit(":"), o["key"])).alias("h"), o["key"].alias("key"), o["text"].alias("text"), F.get("soft_distribution", i).alias("p")))
    d = d.withColumn("o", F.array_sort(one)).withColumn("mass", F.aggregate("soft_distribution", F.lit(0.0), lambda a, x: a + x) + 1e-8)
    gold = F.array_position(F.transform("o", lambda x: x["key"]), F.col("gold_key")) - 1
    return d.select(F.col("id").cast("long").alias("group_id"), F.size("options").alias("k"), F.transform("o", lambda x, i: F.struct(F.char(65 + i).alias("label"), x["key"].alias("key"), x["text"].alias("description"), (x["p"] / F.col("mass")).alias("p"))).alias("o"), F.char(65 + gold).alias("gold_code"), "gold_key")


PERMUTED = f"(SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY md5(group_id || ':' || chr(CAST(65 + slot AS integer)))) - 1 AS place, sum(soft) OVER (PARTITION BY group_id) + 1e-8 AS mass, chr(CAST(65 + slot AS integer)) AS key FROM ({SLOTS}) AS a WHERE kk BETWEEN 2 AND 255) AS b"
code = "chr(CAST(65 + place AS integer))"
query(
    "group_to_v2", lambda spark, sf: order_v2(spark, sf).select("group_id", "k", F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit("="), x["key"], F.lit(":"), x["description"])), "|").alias("options"), "gold_code", "gold_key", F.array_join(F.transform("o", lambda x: F.format_number(x["p"], 4)), ",").alias("probabilities")),
    f"SELECT group_id, CAST(kk AS integer) AS k, string_agg({code} || '=' || key || ':' || part, '|' ORDER BY place) AS options, max({code}) FILTER (is_gold = 1) AS gold_code, max(key) FILTER (is_gold = 1) AS gold_key, string_agg(format('{{:.4f}}', soft / mass), ',' ORDER BY place) AS probabilities FROM {PERMUTED} GROUP BY group_id, kk",
)
query(
    "systemone_format", lambda spark, sf: _prompts(order_v2(spark, sf).unionByName(_single(spark, sf))),
    f"""SELECT group_id, '<start_of_turn>user' || chr(10) || 'State:' || chr(10) || 'Order ' || group_id || chr(10) || chr(10) || 'Question: Which is the dearest?' || chr(10) || 'Options:' || chr(10) || string_agg('[' || {code} || '] ' || key || ': ' || part, chr(10) ORDER BY place) || chr(10) || 'Answer with the option code only.<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt,
        max({code}) FILTER (is_gold = 1) || '<end_of_turn>' AS completion, string_agg({code}, '' ORDER BY place) AS codes FROM (SELECT group_id, part, is_gold, place, key FROM {PERMUTED} UNION ALL SELECT group_id, part, is_gold, 0 AS place, 'A' AS key FROM ({SLOTS}) AS s WHERE kk = 1) AS u GROUP BY group_id""",
)


def _single(spark, sf):
    d = order_decisions(spark, sf).where("size(options) = 1")
    return d.select(F.col("id").cast("long").alias("group_id"), F.lit(1).alias("k"), F.transform("options", lambda o: F.struct(F.lit("A").alias("label"), o["key"].alias("key"), o["text"].alias("description"), F.lit(1.0).alias("p"))).alias("o"), F.lit("A").alias("gold_code"), "gold_key")


#: The turns of a prompt.
TURN = ("<start_of_turn>user\nState:\n", "\n\nQuestion: ", "\nOptions:\n", "\nAnswer with the option code only.<end_of_turn>\n<start_of_turn>model\n", "<end_of_turn>")


def _prompts(d):
    lines = F.array_join(F.transform("o", lambda x: F.concat(F.lit("["), x["label"], F.lit("] "), x["key"], F.when(x["description"] != "", F.concat(F.lit(": "), x["description"])).otherwise(F.lit("")))), "\n")
    prompt = F.concat(F.lit(TURN[0] + "Order "), F.col("group_id").cast("string"), F.lit(f"{TURN[1]}Which is the dearest?{TURN[2]}"), lines, F.lit(TURN[3]))
    return d.select("group_id", prompt.alias("prompt"), F.concat("gold_code", F.lit(TURN[4])).alias("completion"), F.array_join(F.transform("o", lambda x: x["label"]), "").alias("codes"))


def nli_v2(d):
    """A pair as a question of true or false (even ids) or of three ways, the options in a drawn order."""
    swap = d.draw("concat('v2:', id)", 2)
    turn = d.draw("concat('v2:', id)", 3)
    names = ["entailment", "contradiction", "neutral"]
    name = lambda p: d.pick(names, f"({p} + {turn}) % 3")
    gold = "CASE gold WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END"
    soft = "CASE gold WHEN 1 THEN p1 WHEN 0 THEN 1 - p0 ELSE p1 + 0.5e0 * p2 END"
    p = lambda k: f"CASE {name(k)} WHEN 'entailment' THEN p1 WHEN 'contradiction' THEN p0 ELSE p2 END"
    return f"""SELECT id, 'noul' AS kind, CASE {swap} WHEN 0 THEN 'A=true|B=false' ELSE 'A=false|B=true' END AS options, CASE WHEN (gold = 1) = ({swap} = 0) THEN 'A' ELSE 'B' END AS gold_code, CASE WHEN gold = 1 THEN 'true' ELSE 'false' END AS gold_key, round({soft}, 6) AS soft0, round(1 - ({soft}), 6) AS soft1, CAST(NULL AS double) AS soft2 FROM item WHERE id % 2 = 0
        UNION ALL SELECT id, 'choice' AS kind, concat('A=', {name(0)}, '|B=', {name(1)}, '|C=', {name(2)}) AS options, chr(65 + CAST(({gold} - {turn} + 3) % 3 AS int)) AS gold_code, {d.pick(names, gold)} AS gold_key, round({p(0)}, 6) AS soft0, round({p(1)}, 6) AS soft1, round({p(2)}, 6) AS soft2 FROM item WHERE id % 2 = 1"""


sql("nli_to_v2", nli_v2)

# states as text
STATES = [{"prompt": " Hello ", "user_response": "Fine"}, {"empty": "", "none": None, "list": [], "object": {}, "kept": "x"}, {"NESTED_value": {"a": 1, "b": ["c", True]}, "count": 3}, "plain text ", {}, {"only": ""}]
STATE_ROWS = [(i, json.dumps(s, separators=(",", ":"))) for i, s in enumerate(STATES)]


def format_state(record):
    """An object as blocks of a label and a text, without what is empty; a text as it is."""
    entries = F.map_entries(F.from_json(record, "map<string,string>"))
    shown = F.filter(entries, lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "{}", "[]"))
    label = lambda k: (lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2)))))(F.replace(k, F.lit("_"), F.lit(" ")))
    blocks = F.array_join(F.transform(shown, lambda e: F.concat(label(e["key"]), F.lit(": "), R.strip(e["value"]))), "\n\n")
    return F.when(record.startswith("{"), blocks).otherwise(R.strip(F.get_json_object(F.concat(F.lit('{"x":'), record, F.lit("}")), "$.x")))


LIT = "(VALUES " + ", ".join(f"({i}, {literal(r)})" for i, r in STATE_ROWS) + ") AS v(id, j)"
query(
    "format_state", lambda spark, sf: spark.createDataFrame(STATE_ROWS, "id int, record string").select("id", format_state(F.col("record")).alias("state")),
    f"""SELECT id, CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(list_transform(list_filter(json_keys(j), lambda k: coalesce(json_extract_string(j, '$.' || k), '') NOT IN ('', '[]', '{{}}')), lambda k: upper(substr(replace(k, '_', ' '), 1, 1)) || lower(substr(replace(k, '_', ' '), 2)) || ': ' || trim(json_extract_string(j, '$.' || k))), chr(10) || chr(10)) ELSE trim(json_extract_string(j, '$')) END AS state FROM {LIT}""",
)


@F.pandas_udf(StringType())
def pretty(x: pd.Series) -> pd.Series:
    """JSON with two blanks of indent; other text without blanks at its ends."""

    def one(t):
        try:
            return json.dumps(json.loads(t), indent=2)
        except (ValueError, TypeError):
            return (t or "").strip()

    return x.map(one)


def premises(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit(" not json: "), "props")).otherwise(F.col("props")).alias("state"))
    return d.select("event_id", F.concat(F.lit("Domain: events\nContext:\n"), pretty("state")).alias("premise"))


query("state_premise", premises, """SELECT event_id, 'Domain: events' || chr(10) || 'Context:' || chr(10) || CASE WHEN event_id % 10 = 0 THEN trim(' not json: ' || props) ELSE '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' END AS premise FROM events""")

# answers of authoring models: a list, an object with samples or data, Python literals, cut-off streams, single objects in prose
AUTHORED = [
    '{"samples": [{"premise": "a", "hypothesis": "b", "label": 1}, {"premise": "c", "hypothesis": " d ", "label": "0"}]}', '```json\n[{"premise": "e", "hypothesis": "f", "label": 2}]\n```', "Here: {'data': [{'premise': 'g', 'hypothesis': \"it's\", 'label': 0},]} done",
    '{"samples": [{"premise": "h", "hypothesis": "i", "label": 1}, {"premise": "cut', 'noise {"premise": "j", "hypothesis": "k", "label": 2, bad} more {"premise": "l", "hypothesis": "m", "label": 1}', "nothing here", '{"samples": [{"premise": "n", "label": 1}, {"premise": "o", "hypothesis": "p", "label": "x"}, {"premise": "q", "hypothesis": "r", "label": 7}]}', "",
]
@F.pandas_udf(ArrayType(StructType([StructField(k, StringType()) for k in ("premise", "hypothesis", "label")])))
def items(x: pd.Series) -> pd.Series:
    text = lambda v: None if v is None else str(v)
    return x.map(lambda t: [{k: text(i.get(k)) for k in ("premise", "hypothesis", "label")} for i in salvaged(t) if isinstance(i, dict)])


authored = lambda spark: spark.createDataFrame(list(enumerate(AUTHORED)), "id int, answer string").repartition(2).select("id", F.posexplode(items("answer")).alias("place", "item")).select("id", "place", "item.*")
READ = [(0, 0, "a", "b", "1"), (0, 1, "c", " d ", "0"), (1, 0, "e", "f", "2"), (2, 0, "g", "it's", "0"), (3, 0, "h", "i", "1"), (4, 0, "j", "k", "2"), (4, 1, "l", "m", "1"), (6, 0, "n", None, "1"), (6, 1, "o", "p", "x"), (6, 2, "q", "r", "7")]
VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else literal(v) for v in r) + ")" for r in rows)
query("robust_parse", lambda spark, sf: authored(spark), f"SELECT * FROM (VALUES {VALUES(READ)}) AS t(id, place, premise, hypothesis, label)")
query(
    "teacher_ingest", lambda spark, sf: authored(spark).withColumn("label", F.col("label").try_cast("int")).where("premise IS NOT NULL AND hypothesis IS NOT NULL AND label BETWEEN 0 AND 2").select("id", R.strip(F.col("premise")).alias("premise"), R.strip(F.col("hypothesis")).alias("hypothesis"), "label"),
    f"SELECT id, trim(premise) AS premise, trim(hypothesis) AS hypothesis, CAST(label AS integer) AS label FROM (VALUES {VALUES([r for r in READ if r[3] is not None and r[4] in '012'])}) AS t(id, place, premise, hypothesis, label)",
)

# answers of judges to batches: a list or an object with verdicts, in fences, in prose; else an error for the whole batch
ANSWERS = [
    (0, '[{"id": 0, "verdict": "entailment", "rationale": "r"}, {"id": 1, "verdict": " Neutral "}, {"id": 2, "verdict": "maybe"}]'), (1, '```json\n{"verdicts": [{"id": 2, "verdict": "contradiction"}]}\n```'), (2, 'Sure: [{"id": "1", "verdict": "entailment"}] Done.'), (3, "no json"), (4, ""), (5, '{"other": 1}'), (6, None),
]
BATCH = 3


def verdicts(spark, sf):
    """ok, invalid, missing, parse_error or offline for every sample of every batch."""
    d = spark.createDataFrame(ANSWERS, "batch int, answer string")
    clean = F.trim(F.regexp_replace(F.trim(F.coalesce("answer", F.lit(""))), r"^```(?:json)?\s*|\s*```$", ""))
    read = lambda x: F.when(x.rlike(r"(?s)^\s*\["), F.from_json(x, "array<struct<id: string, verdict: string>>"))
    shaped = lambda x: F.coalesce(read(x), read(F.get_json_object(x, "$.verdicts")))
    d = d.withColumn("clean", clean).withColumn("inner", F.regexp_extract("clean", r"(?s)(\[.*\]|\{.*\})", 1))
    d = d.withColumn("list", F.coalesce(shaped(F.col("clean")), shaped(F.col("inner"))))
    d = d.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(BATCH - 1)))).withColumn("v", F.get(F.filter("list", lambda v: v["id"] == F.col("sample").cast("string")), F.lit(0)))
    name = F.lower(F.trim(F.coalesce("v.verdict", F.lit(""))))
    label = F.when(name == "contradiction", 0).when(name == "entailment", 1).when(name == "neutral", 2)
    status = F.when(F.coalesce("answer", F.lit("")) == "", "offline").when(F.col("list").isNull(), "parse_error").when(F.col("v").isNull(), "missing").when(label.isNull(), "invalid").otherwise("ok")
    return d.select("batch", "sample", status.alias("status"), label.alias("label"))


JUDGED = [(0, 0, "ok", 1), (0, 1, "ok", 2), (0, 2, "invalid", None), (1, 0, "missing", None), (1, 1, "missing", None), (1, 2, "ok", 0), (2, 0, "missing", None), (2, 1, "ok", 1), (2, 2, "missing", None)] + [(b, s, "offline" if b in (4, 6) else "parse_error", None) for b in (3, 4, 5, 6) for s in range(BATCH)]
query("parse_verdicts", verdicts, f"SELECT * FROM (VALUES {VALUES(JUDGED)}) AS t(batch, sample, status, label)")
