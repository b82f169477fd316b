"""Queries over the record converters: records as datasets publish them, good and malformed, and separate SQL for the oracle."""

import json

from pyspark.sql import functions as F

from gavelflow.operators import records as R

from .base import DUCK, expand, query, tables

RECORDS = {
    "conv_casehold": [
        {"context": " The court held <HOLDING> here ", "endings": ["that it applies", " that it fails ", "nothing", "remand", "deny"], "label": 1},
        {"context": "In re X <HOLDING>", "endings": ["a", "b"], "label": 0}, {"context": "bad label", "endings": ["a", "b"], "label": 7}, {"context": "negative", "endings": ["a", "b"], "label": -1},
        {"context": "  ", "endings": ["a", "b"], "label": 0}, {"context": "no endings", "endings": [], "label": 0}, {"context": "no label", "endings": ["a"]}, "{broken", {"context": "one", "endings": ["only"], "label": 0},
    ],
    "conv_race": [
        {"example_id": "high1.txt", "article": "An article.\nTwo lines.", "question": "Who?", "options": ["he", " she", "they", "it"], "answer": "C"}, {"article": "Another", "question": "When?", "options": ["now", "then"], "answer": 1},
        {"article": "Lower", "question": "Which?", "options": ["p", "q", "r", "s"], "answer": " b "}, {"article": "Text number", "question": "Which?", "options": ["p", "q", "r", "s"], "answer": "3"}, {"article": "Out", "question": "?", "options": ["p", "q"], "answer": "D"},
        {"article": "Word", "question": "?", "options": ["p", "q"], "answer": "AB"}, {"article": "", "question": "?", "options": ["p"], "answer": "A"}, {"article": "No answer", "question": "?", "options": ["p"]}, "[]",
    ],
    "conv_reclor": [
        {"context": "Premises", "question": "Which follows?", "answers": ["p", "q", "r", "s"], "label": 0, "id_string": "train_12"}, {"context": "No id", "question": "So?", "answers": ["p", "q"], "label": 1},
        {"context": "Bad", "question": "So?", "answers": ["p", "q"], "label": 2}, {"context": "Null", "question": "So?", "answers": None, "label": 0}, {"context": "Blank", "question": " ", "answers": ["p"], "label": 0},
    ],
    "conv_logiqa": [
        {"id": 17, "text": "All A are B", "question": "So?", "options": ["some B are A", "none"], "answer": 0}, {"text": "No id", "question": "y", "options": ["a", "b", "c", "d"], "answer": 3}, {"id": "x9", "text": "Bad", "question": "y", "options": ["a"], "answer": 1},
        {"id": 3, "text": "No options", "question": "y", "answer": 0}, {"id": 4, "question": "no text", "options": ["a"], "answer": 0},
    ],
    "conv_pubmedqa": [
        {"pubid": 1, "question": "Does it work?", "context": {"contexts": ["Aim. ", "", "Result."]}, "final_decision": "maybe"}, {"pubid": 2, "question": "Is it safe?", "context": ["One", "Two"], "final_decision": "Yes "},
        {"question": "Text?", "context": " plain text ", "final_decision": "no"}, {"pubid": 4, "question": "Unsure?", "context": "c", "final_decision": "perhaps"}, {"pubid": 5, "question": "", "context": "c", "final_decision": "no"}, {"pubid": 6, "question": "Empty?", "context": {"contexts": []}, "final_decision": "no"},
    ],
    "conv_csqa": [
        {"id": "s1", "question": "Where do fish live?", "question_concept": "fish", "choices": {"label": ["A", "B", "C"], "text": ["water ", "desert", "sky"]}, "answerKey": "a"}, {"question": "No concept?", "choices": {"label": ["A", "B"], "text": ["p", "q"]}, "answerKey": "B"},
        {"id": "s3", "question": "Key?", "choices": {"label": ["A", "B"], "text": ["p", "q"]}, "answerKey": "E"}, {"id": "s4", "question": "Uneven?", "choices": {"label": ["A", "B"], "text": ["p"]}, "answerKey": "A"}, {"id": "s5", "question": "Empty?", "choices": {"label": ["A"], "text": ["p"]}, "answerKey": ""},
    ],
    "conv_lsat_ar": [
        {"context": "Six people sit", "question": "Who is third?", "answers": ["F", "G", "H", "I", "J"], "label": 4, "id_string": "1991_06"}, {"context": "No id", "question": "?", "answers": ["F", "G"], "label": 0}, {"context": "Bad", "question": "?", "answers": ["F", "G"], "label": 5}, {"context": "None", "question": "?", "answers": ["F"], "label": None},
    ],
    "conv_strategyqa": [
        {"qid": "y1", "question": "Could it?", "facts": ["Fact one ", " ", "Fact two"], "answer": False}, {"question": "No facts?", "answer": True}, {"qid": "y3", "question": "Blank facts?", "facts": [""], "answer": True}, {"qid": "y4", "question": "No answer?", "facts": ["f"]}, {"qid": "y5", "question": "", "facts": [], "answer": True},
    ],
    "conv_aqua": [
        {"question": "2 x 15 = ?", "options": ["A)21", "B) 30", "C): 4", "D:9", "E)  1"], "correct": "B"}, {"question": "Plain", "options": ["7", "8"], "correct": " a"}, {"question": "Out", "options": ["A)1", "B)2"], "correct": "E"}, {"question": "Not a letter", "options": ["A)1"], "correct": "1"}, {"question": "", "options": ["A)1"], "correct": "A"},
    ],
    "bench_arc": [
        {"question": "Which is hot?", "choices": {"text": ["ice", "fire"], "label": ["1", "2"]}, "answerKey": "2"}, {"question": "Bad key", "choices": {"text": ["a", "b"], "label": ["A", "B"]}, "answerKey": "C"}, {"question": "Letters", "choices": {"text": ["a", "b", "c", "d"], "label": ["A", "B", "C", "D"]}, "answerKey": "A"},
    ],
    "bench_mmlu": [{"question": "2+2?", "choices": ["3", "4", "5", "22"], "answer": 1}, {"question": "As text", "choices": ["x", "y"], "answer": "0"}, {"question": "Out", "choices": ["x", "y"], "answer": 4}],
    "bench_winogrande": [{"sentence": "The trophy beat the case: the _ is big, the _ wins.", "option1": "cup", "option2": "box", "answer": "2"}, {"sentence": "A _.", "option1": "p", "option2": "q", "answer": "1"}, {"option1": "p", "option2": "q", "answer": "1"}],
    "bench_boolq": [{"passage": "It rains.", "question": "is it wet", "answer": True}, {"passage": "It is dry.", "question": "is it wet", "answer": False}, {"question": "no passage", "answer": True}],
    "bench_topics": [{"text": "Stocks fell", "label": 2}, {"text": "They won", "label": 1}, {"text": "Unknown", "label": 4}],
    "bench_emotion": [{"text": "I am so happy", "label": 1}, {"text": "Never seen that", "label": 5}, {"label": 0}],
    "when2call": [
        {"question": " What is the weather? ", "tools": [{"name": "weather"}], "answers": ["direct", "tool_call ", "", "cannot_answer"], "correct_answer": "tool_call", "held_out_param": "city"}, {"question": "Hi", "tools": "none", "answers": "direct", "correct_answer": "direct"}, {"question": "", "answers": ["a"], "correct_answer": "a"}, {"question": "Nothing", "correct_answer": "x"},
    ],
    "decisions": [
        {"id": "d1", "domain": "ops", "context": " State ", "question": "What now?", "options": ["wait", {"key": "X", "text": "act"}, {"desc": "ask"}], "gold_index": 1, "soft_distribution": [0.1, 0.7, 0.2]}, {"id": "d2", "premise": "Only a premise", "options": ["yes", "no"], "gold_index": 0, "gold_key": "Z"},
        {"id": "d3", "options": [], "gold_index": 0}, {"id": "d4", "options": ["same", "same"], "gold_index": 0}, {"id": "d5", "options": ["a", "b"], "gold_index": 2}, {"id": "d6", "context": "c", "options": ["only"]}, {"id": "d7", "options": [str(i) for i in range(21)], "gold_index": 3},
        {"id": "d8", "question": "Soft?", "options": ["p", "q"], "gold_index": 1, "soft_distribution": [0.5]}, {"id": "d9", "options": ["a", {"text": "a"}], "gold_index": 0},
    ],
    "render_options": [
        {"t": "choice", "crit": {"low": "little", "high": ""}}, {"t": "score", "crit": ["none", "some", "all"]}, {"t": "noul", "crit": {"true": "it holds"}}, {"t": "noul"},
    ],
}


def json_rows(name):
    return [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(RECORDS[name])]


def frame(spark, name):
    return spark.createDataFrame(json_rows(name), "index int, record string")


# the oracle's own reading of the records
WHITE = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
raw = lambda p: f"json_extract_string(j, '$.{p}')"
strip = lambda p: f"trim({raw(p)}, {WHITE})"
full = lambda p: f"nullif({strip(p)}, '')"
items = lambda p: f"json_extract_string(j, '$.{p}[*]')"
number = lambda p: f"TRY_CAST({raw(p)} AS INTEGER)"
place = lambda x, last: f"CASE WHEN {x} BETWEEN 'A' AND '{last}' AND len({x}) = 1 THEN ascii({x}) - 65 END"
asked = lambda a, b="question": f"{full(a)} || '\n\nQuestion: ' || {full(b)}"
named = lambda p, other="": f"'train_' || coalesce({raw(p)}, '{other}' || n)"
listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def source(name):
    values = ", ".join(f"({i}, '{r.replace(chr(39), chr(39) * 2)}')" for i, r in json_rows(name))
    return f"(SELECT n, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS j FROM (VALUES {values}) AS v(n, j))"


def candidates_sql(name, dataset, key, premise, options, gold, served=R.SERVED):
    head, tail = served.split("{}")
    return f"""SELECT group_id || '_opt_' || i AS id, group_id, premise, '{head}' || trim(coalesce(options[i + 1], ''), {WHITE}) || '{tail}' AS hypothesis, CAST(i = gold AS INTEGER) AS label, i = gold AS is_gold, CAST(i = gold AS DOUBLE) AS soft_target, CAST(i AS INTEGER) AS slot
        FROM (SELECT '{dataset}_' || {key} AS group_id, {premise} AS premise, {options} AS options, {gold} AS gold FROM {source(name)}) AS p, unnest(range(0, len(options))) AS u(i) WHERE premise IS NOT NULL AND group_id IS NOT NULL AND gold >= 0 AND gold < len(options)"""


def register(name, dataset, converter, *oracle, served=R.SERVED):
    query(name, lambda spark, sf: R.candidates(frame(spark, name), dataset, converter()), candidates_sql(name, dataset, *oracle, served=served))


register("conv_casehold", "casehold", R.holdings, "'train_' || n", f"'Select the legal holding that correctly completes the citation in the context:\n\n' || {full('context')}", items("endings"), number("label"))
register("conv_race", "race", R.reading, named("example_id", "ex_"), asked("article"), items("options"), f"coalesce({place(f'upper({strip(chr(97) + chr(110) + chr(115) + chr(119) + chr(101) + chr(114))})', 'D')}, {number('answer')})")
register("conv_reclor", "reclor", R.reasoning, named("id_string", "reclor_train_"), asked("context"), items("answers"), number("label"))
register("conv_logiqa", "logiqa", R.logic, named("id"), asked("text"), items("options"), number("answer"))
ABSTRACT = f"""nullif(CASE json_type(j, '$.context') WHEN 'OBJECT' THEN array_to_string(list_transform(list_filter({items('context.contexts')}, lambda x: coalesce(x, '') <> ''), lambda x: trim(x, {WHITE})), '\n')
    WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter({items('context')}, lambda x: coalesce(x, '') <> ''), lambda x: trim(x, {WHITE})), '\n') ELSE {strip('context')} END, '')"""
ABSTRACT = f"'Biomedical Abstract:\n' || {ABSTRACT} || '\n\nQuestion: ' || {full('question')}"
register("conv_pubmedqa", "pubmedqa", R.abstracts, named("pubid"), ABSTRACT, "['yes', 'no', 'maybe']", f"CASE lower({strip('final_decision')}) WHEN 'yes' THEN 0 WHEN 'no' THEN 1 WHEN 'maybe' THEN 2 END")
query(
    "conv_pubmedqa_classes", lambda spark, sf: R.abstract_rows(frame(spark, "conv_pubmedqa")),
    f"SELECT 'pubmedqa_nli_' || {named('pubid')} AS id, {ABSTRACT} AS premise, 'Based on the biomedical evidence, the answer is: ' || lower({strip('final_decision')}) || '.' AS hypothesis, CAST(CASE lower({strip('final_decision')}) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 WHEN 'maybe' THEN 2 END AS INTEGER) AS label FROM {source('conv_pubmedqa')} WHERE {ABSTRACT} IS NOT NULL AND lower({strip('final_decision')}) IN ('yes', 'no', 'maybe')",
)
register("conv_csqa", "csqa", R.commonsense, f"'train_' || coalesce({raw('id')}, 'csqa_' || n)", f"coalesce('Concept: ' || {full('question_concept')} || '\n', '') || 'Question: ' || {full('question')}", items("choices.text"), f"CASE WHEN len({items('choices.label')}) = len({items('choices.text')}) THEN list_position({items('choices.label')}, nullif(upper({strip('answerKey')}), '')) - 1 END")
register("conv_lsat_ar", "lsat_ar", R.puzzles, named("id_string", "lsat_ar_"), f"'Analytical Reasoning Puzzle:\n' || {asked('context')}", items("answers"), number("label"))
FACTS = f"array_to_string(list_transform(list_filter({items('facts')}, lambda x: trim(x, {WHITE}) <> ''), lambda x: '- ' || trim(x, {WHITE})), '\n')"
register("conv_strategyqa", "strategy_qa", R.strategies, named("qid", "strat_"), f"CASE WHEN coalesce({FACTS}, '') <> '' THEN 'Contextual Facts:\n' || {FACTS} || '\n\n' ELSE '' END || 'Question: ' || {full('question')}", "['Yes', 'No']", f"CASE {raw('answer')} WHEN 'true' THEN 0 WHEN 'false' THEN 1 END")
register("conv_aqua", "aqua_rat", R.algebra, "'train_' || n", f"'Solve the following mathematical/numerical problem:\n\n' || {full('question')}", f"list_transform({items('options')}, lambda x: regexp_replace(trim(x, {WHITE}), '^[A-E][):][ \t\n]*', ''))", place(f"upper({strip('correct')})", "E"))
register("bench_arc", "arc", R.science, "n", raw("question"), items("choices.text"), f"list_position({items('choices.label')}, {raw('answerKey')}) - 1")
register("bench_mmlu", "mmlu", R.subjects, "n", raw("question"), items("choices"), number("answer"))
FILLED = ", ".join(f"replace({raw('sentence')}, '_', {raw(f'option{i}')})" for i in (1, 2))
register("bench_winogrande", "winogrande", R.gaps, "n", f"CASE WHEN {raw('sentence')} IS NOT NULL THEN 'Statement verification:' END", f"[{FILLED}]", f"CASE WHEN {raw('answer')} = '1' THEN 0 ELSE 1 END", served="This statement is correct and logical: {}")
register("bench_boolq", "boolq", R.passages, "n", f"'Passage: ' || {raw('passage')} || '\nQuestion: ' || {raw('question')} || '?'", "['Yes, this is true.', 'No, this is false.']", f"CASE WHEN {raw('answer')} = 'true' THEN 0 ELSE 1 END", served="The factual answer is: {}")
register("bench_topics", "ag_news", lambda: R.classes("News Article: ", R.TOPICS, R.SERVED_TOPIC), "n", f"'News Article: ' || {raw('text')}", listed(R.TOPICS), number("label"), served="The primary topic of this article is: {}")
register("bench_emotion", "emotion", lambda: R.classes("Statement: ", R.EMOTIONS, R.SERVED_EMOTION), "n", f"'Statement: ' || {raw('text')}", listed(R.EMOTIONS), number("label"), served="The author feels {}.")

W2C = f"""(SELECT n, substr({full('question')}, 1, 2500) || '\nAvailable tools: ' || substr(coalesce({raw('tools')}, 'null'), 1, 1200) AS premise, CASE WHEN json_type(j, '$.answers') = 'ARRAY' THEN {items('answers')} ELSE [{raw('answers')}] END AS answers,
    coalesce({strip('correct_answer')}, '') AS correct, {full('held_out_param')} AS held FROM {source('when2call')}) AS d"""
query(
    "when2call", lambda spark, sf: R.tool_choices(frame(spark, "when2call")),
    f"""SELECT CAST(n AS INTEGER) AS index, premise, 'The assistant should: ' || substr(o, 1, 300) AS hypothesis, CAST(o = correct AS INTEGER) AS label, 'when2call' AS source FROM (SELECT n, premise, correct, trim(coalesce(x, 'None'), {WHITE}) AS o FROM {W2C}, unnest(answers) AS u(x) WHERE premise IS NOT NULL) AS t WHERE o <> ''
        UNION ALL SELECT CAST(n AS INTEGER) AS index, premise, 'The value of `' || held || '` is stated in the user request.' AS hypothesis, 0 AS label, 'when2call_param' AS source FROM {W2C} WHERE premise IS NOT NULL AND held IS NOT NULL""",
)

# canonical decisions
flat = lambda d: d.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit("="), o["text"])), "|"))
KEY = "chr(CAST(65 + least(i - 1, 19) AS INTEGER))"
OPTION = f"lambda x, i: CASE json_type(x) WHEN 'OBJECT' THEN {{'k': coalesce(json_extract_string(x, '$.key'), {KEY}), 't': coalesce(json_extract_string(x, '$.text'), json_extract_string(x, '$.desc'), '')}} ELSE {{'k': {KEY}, 't': json_extract_string(x, '$')}} END"
DECIDED = f"""(SELECT *, CASE WHEN len(o) NOT BETWEEN 1 AND 20 THEN 'number of options' WHEN len(list_distinct(list_transform(o, lambda x: x.t))) < len(o) THEN 'equal options' WHEN gold < 0 OR gold >= len(o) THEN 'gold outside' END AS problem
    FROM (SELECT {raw('id')} AS id, coalesce({raw('domain')}, 'general') AS domain, coalesce({raw('context')}, {raw('premise')}, '') AS context, coalesce({raw('question')}, '') AS question, list_transform(json_extract(j, '$.options[*]'), {OPTION}) AS o, coalesce({number('gold_index')}, 0) AS gold, {raw('gold_key')} AS own,
        list_transform({items('soft_distribution')}, lambda x: CAST(x AS DOUBLE)) AS soft FROM {source('decisions')}) AS a) AS d"""
query(
    "decision_from_dict", lambda spark, sf: flat(R.decisions(frame(spark, "decisions"))).select("id", "domain", "context", "question", "options", "gold_index", "gold_key", "problem"),
    f"SELECT id, domain, context, question, array_to_string(list_transform(o, lambda x: x.k || '=' || x.t), '|') AS options, CAST(gold AS INTEGER) AS gold_index, CASE WHEN problem IS NULL THEN coalesce(nullif(own, ''), o[gold + 1].k) END AS gold_key, problem FROM {DECIDED}",
)
query(
    "validate_decision", lambda spark, sf: R.decisions(frame(spark, "decisions")).select("id", F.coalesce("problem", F.lit("ok")).alias("reason"), "gold_key"),
    f"SELECT id, coalesce(problem, 'ok') AS reason, CASE WHEN problem IS NULL THEN coalesce(nullif(own, ''), o[gold + 1].k) END AS gold_key FROM {DECIDED}",
)
query(
    "grouped_pairs", lambda spark, sf: R.decision_pairs(R.decisions(frame(spark, "decisions"))),
    f"""SELECT id || '_opt_' || o[i].k AS id, id AS group_id, CASE WHEN question <> '' THEN trim(context, {WHITE}) || '\nQuestion: ' || trim(question, {WHITE}) ELSE trim(context, {WHITE}) END AS premise, 'The correct answer is: ' || o[i].k || ': ' || o[i].t AS hypothesis, CAST(i - 1 = gold AS INTEGER) AS label,
        CASE WHEN len(soft) = len(o) THEN soft[i] ELSE CAST(i - 1 = gold AS DOUBLE) END AS soft_target FROM {DECIDED}, unnest(range(1, len(o) + 1)) AS u(i) WHERE problem IS NULL""",
)
query(
    "render_options", lambda spark, sf: frame(spark, "render_options").select("index", F.posexplode(R.option_texts()).alias("slot", "option")),
    f"""SELECT CAST(n AS INTEGER) AS index, CAST(i - 1 AS INTEGER) AS slot, o[i] AS option FROM (SELECT n, CASE {raw('t')} WHEN 'choice' THEN list_transform(json_keys(j, '$.crit'), lambda k: k || coalesce(': ' || nullif(json_extract_string(j, '$.crit.' || k), ''), ''))
        WHEN 'score' THEN list_transform({items('crit')}, lambda x, i: 'level ' || (i - 1) || ': ' || x) ELSE ['false: ' || coalesce(nullif({raw('crit.false')}, ''), 'no, the statement does not hold'), 'true: ' || coalesce(nullif({raw('crit.true')}, ''), 'yes, the statement holds')] END AS o FROM {source('render_options')}) AS t, unnest(range(1, len(o) + 1)) AS u(i)""",
)


# decisions made of the lines of an order: options are parts, the soft distribution their discounts
def order_decisions(spark, sf):
    text = expand("SELECT group_id, ord, part, score, soft, is_gold FROM grouped", _spark)
    tables(spark, sf, text)
    d = spark.sql(text).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ord", "part", "score", "soft", "is_gold"))).alias("o"))
    return d.select(
        F.col("group_id").cast("string").alias("id"), F.lit("orders").alias("domain"), F.lit("").alias("context"), F.lit("best part?").alias("question"), F.transform("o", lambda x, i: F.struct(R.key(i).alias("key"), F.concat(x["part"].cast("string"), F.lit("#"), i.cast("string")).alias("text"))).alias("options"),
        (F.array_position(F.transform("o", lambda x: x["is_gold"]), 1) - 1).cast("int").alias("gold_index"), F.transform("o", lambda x: x["soft"].cast("double")).alias("soft_distribution"),
    ).withColumn("problem", F.when(F.size(F.array_distinct(F.transform("options", lambda x: x["text"]))) < F.size("options"), "equal options")).withColumn("gold_key", F.get("options", F.col("gold_index"))["key"])


from .base import SPARK as _spark  # noqa: E402

SLOTS = "SELECT * EXCLUDE (part), part || '#' || slot AS part FROM (" + expand("SELECT group_id, part, soft, is_gold, row_number() OVER (PARTITION BY group_id ORDER BY ord, part, score) - 1 AS slot, count(*) OVER (PARTITION BY group_id) AS kk FROM grouped", DUCK) + ") AS slots"


def permutations(spark, sf):
    """A row for each option of each rotation."""
    d = R.rotations(order_decisions(spark, sf)).select(F.split_part("id", F.lit("_"), F.lit(1)).cast("long").alias("group_id"), "id", "gold_index", "gold_key", "soft_distribution", F.posexplode("options").alias("position", "o"))
    return d.select("group_id", "id", "position", "o.key", "o.text", (F.col("position") == F.col("gold_index")).cast("int").alias("is_gold"), "gold_key", F.get("soft_distribution", F.col("position")).alias("soft"))


query(
    "cyclic_permutations", permutations,
    f"""SELECT group_id, CASE WHEN kk = 1 THEN group_id || '' ELSE group_id || '_perm_' || s END AS id, CAST(p AS INTEGER) AS position, chr(CAST(65 + p AS INTEGER)) AS key, part AS text, is_gold, chr(CAST(65 + max(p) FILTER (is_gold = 1) OVER (PARTITION BY group_id, s) AS INTEGER)) AS gold_key, CAST(soft AS DOUBLE) AS soft
        FROM (SELECT *, (slot - s + kk) % kk AS p FROM ({SLOTS}) AS a, unnest(range(0, kk)) AS u(s)) AS b""",
)
query(
    "incontext_prompt", lambda spark, sf: order_decisions(spark, sf).where("problem IS NULL").select(F.col("id").cast("long").alias("group_id"), R.prompt().alias("prompt"), "gold_key"),
    f"SELECT group_id, 'Question: best part?\nOptions:\n' || string_agg(chr(CAST(65 + slot AS INTEGER)) || ': ' || part, '\n' ORDER BY slot) || '\nDecision: ' AS prompt, max(chr(CAST(65 + slot AS INTEGER))) FILTER (is_gold = 1) AS gold_key FROM ({SLOTS}) AS a GROUP BY group_id",
)
