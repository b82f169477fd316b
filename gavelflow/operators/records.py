"""Task records to candidate rows: one row for each option of a question.

Records are JSON strings, as datasets publish them; a field of the wrong kind
counts as missing, and a record that lacks what its converter needs gives no
rows. ``converter`` names what differs between datasets: where the premise, the
options and the right one are. All is built-in functions on columns, so the
conversion is one narrow stage over any number of records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentences in which an option is served, the words around the parts of a record, the descriptions of
#: classes and fixed options, and the largest number of options with standard keys.
SERVED = "The correct answer is: {}"
SERVED_GAP, SERVED_PASSAGE, SERVED_TOPIC, SERVED_EMOTION = "This statement is correct and logical: {}", "The factual answer is: {}", "The primary topic of this article is: {}", "The author feels {}."
QUESTION = "\n\nQuestion: "
HOLDING = "Select the legal holding that correctly completes the citation in the context:\n\n"
ABSTRACT, ABSTRACT_ANSWER = "Biomedical Abstract:\n", "Based on the biomedical evidence, the answer is: "
CONCEPT, PUZZLE, FACTS = "Concept: ", "Analytical Reasoning Puzzle:\n", "Contextual Facts:\n"
PROBLEM, GAP = "Solve the following mathematical/numerical problem:\n\n", "Statement verification:"
TRUE_FALSE = ["Yes, this is true.", "No, this is false."]
TOPICS = ["World news, foreign affairs, and international politics.", "Sports competitions, athletic teams, and games.", "Business, corporate earnings, stock markets, and economy.", "Science, computer technology, software, and engineering."]
EMOTIONS = ["sadness and sorrow", "joy and happiness", "love and affection", "anger and irritation", "fear and anxiety", "surprise and astonishment"]
ASSISTANT, HELD_OUT = "The assistant should: ", ("The value of `", "` is stated in the user request.")
NOUL = {"false": "no, the statement does not hold", "true": "yes, the statement holds"}
MOST_OPTIONS = 20


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def text(path: str) -> Column:
    """A field as stripped text; missing is null, numbers and booleans as JSON writes them."""
    return strip(F.get_json_object("record", f"$.{path}"))


def filled(path: str) -> Column:
    """A field as stripped text, null where that is empty."""
    return F.nullif(text(path), F.lit(""))


def strings(path: str) -> Column:
    return F.from_json(F.get_json_object("record", f"$.{path}"), "array<string>")


def whole(path: str) -> Column:
    """A field as a whole number."""
    return F.expr(f"try_cast(get_json_object(record, '$.{path}') AS int)")


def letter(x: Column, last: str) -> Column:
    """The place of a letter from A to ``last``, else null."""
    return F.when(x.between("A", last) & (F.length(x) == 1), F.ascii(x) - 65)


def key(i: Column) -> Column:
    """A..T; later options share the last key."""
    return F.char(F.least(i, F.lit(MOST_OPTIONS - 1)) + 65)


@dataclass(frozen=True)
class Converter:
    """premise, options (array of text) and gold (place of the right one) of a record; name: of its group, without the dataset."""

    name: Column
    premise: Column
    options: Column
    gold: Column
    served: str = SERVED


def candidates(records: DataFrame, dataset: str, c: Converter) -> DataFrame:
    """records (index, record) -> id, group_id, premise, hypothesis, label (1 right, 0 wrong), is_gold, soft_target, slot."""
    head, tail = c.served.split("{}")
    d = records.select(F.concat(F.lit(f"{dataset}_"), c.name).alias("group_id"), c.premise.alias("premise"), c.options.alias("options"), c.gold.cast("int").alias("gold"))
    d = d.where("group_id IS NOT NULL AND premise IS NOT NULL AND gold >= 0 AND gold < size(options)")
    d = d.select("group_id", "premise", "gold", F.posexplode("options").alias("slot", "option"))
    right = F.col("slot") == F.col("gold")
    return d.select(
        F.concat("group_id", F.lit("_opt_"), "slot").alias("id"), "group_id", "premise", F.concat(F.lit(head), strip(F.coalesce("option", F.lit(""))), F.lit(tail)).alias("hypothesis"),
        right.cast("int").alias("label"), right.alias("is_gold"), right.cast("double").alias("soft_target"), "slot",
    )


def _name(field: str | None, split: str = "train", default: str = "") -> Column:
    own = F.col("index").cast("string") if field is None else F.coalesce(F.get_json_object("record", f"$.{field}"), F.concat(F.lit(default), F.col("index").cast("string")))
    return F.concat(F.lit(f"{split}_"), own)


def _asked(context: Column, question: Column) -> Column:
    return F.concat(context, F.lit(QUESTION), question)


def holdings() -> Converter:
    """A legal context, five endings, the place of the right one."""
    return Converter(_name(None), F.concat(F.lit(HOLDING), filled("context")), strings("endings"), whole("label"))


def reading() -> Converter:
    """An article with a question; the answer is a letter from A to D or a place."""
    answer = F.upper(text("answer"))
    return Converter(_name("example_id", default="ex_"), _asked(filled("article"), filled("question")), strings("options"), F.coalesce(letter(answer, "D"), whole("answer")))


def reasoning() -> Converter:
    return Converter(_name("id_string", default="reclor_train_"), _asked(filled("context"), filled("question")), strings("answers"), whole("label"))


def logic() -> Converter:
    return Converter(_name("id"), _asked(filled("text"), filled("question")), strings("options"), whole("answer"))


def _abstract() -> Column:
    """The context of a record: an object with a list, a list, or plain text."""
    listed = F.coalesce(strings("context.contexts"), strings("context"))
    joined = F.array_join(F.transform(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != ""), strip), "\n")
    return F.nullif(F.when(listed.isNotNull(), joined).otherwise(text("context")), F.lit(""))


def abstracts() -> Converter:
    """An abstract with a question that is answered by yes, no or maybe."""
    options = F.array(*map(F.lit, ("yes", "no", "maybe")))
    premise = F.concat(F.lit(ABSTRACT), _asked(_abstract(), filled("question")))
    return Converter(_name("pubid"), premise, options, F.array_position(options, F.lower(text("final_decision"))) - 1)


def abstract_rows(records: DataFrame) -> DataFrame:
    """The same records as one row each with three classes: yes follows, no contradicts, maybe is open."""
    c = abstracts()
    d = records.select(F.concat(F.lit("pubmedqa_nli_"), c.name).alias("id"), c.premise.alias("premise"), F.lower(text("final_decision")).alias("answer"))
    label = F.when(F.col("answer") == "yes", 1).when(F.col("answer") == "no", 0).when(F.col("answer") == "maybe", 2)
    d = d.withColumn("label", label).where("premise IS NOT NULL AND label IS NOT NULL")
    return d.select("id", "premise", F.concat(F.lit(ABSTRACT_ANSWER), "answer", F.lit(".")).alias("hypothesis"), "label")


def commonsense() -> Converter:
    """Parallel lists of labels and texts; the answer is one of the labels."""
    labels, texts = strings("choices.label"), strings("choices.text")
    concept = F.coalesce(F.concat(F.lit(CONCEPT), filled("question_concept"), F.lit("\n")), F.lit(""))
    gold = F.when(F.size(labels) == F.size(texts), F.array_position(labels, F.nullif(F.upper(text("answerKey")), F.lit(""))) - 1)
    name = F.concat(F.lit("train_"), F.coalesce(F.get_json_object("record", "$.id"), F.concat(F.lit("csqa_"), F.col("index").cast("string"))))
    return Converter(name, F.concat(concept, F.lit("Question: "), filled("question")), texts, gold)


def puzzles() -> Converter:
    return Converter(_name("id_string", default="lsat_ar_"), F.concat(F.lit(PUZZLE), _asked(filled("context"), filled("question"))), strings("answers"), whole("label"))


def strategies() -> Converter:
    """Facts as bullets, and a question that is true or false."""
    facts = F.array_join(F.transform(F.filter(F.transform(F.coalesce(strings("facts"), F.array()), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    question = F.concat(F.lit("Question: "), filled("question"))
    answer = F.get_json_object("record", "$.answer")
    yes = answer.isin("true", "1")
    return Converter(_name("qid", default="strat_"), F.when(facts != "", F.concat(F.lit(FACTS), facts, F.lit("\n\n"), question)).otherwise(question), F.array(F.lit("Yes"), F.lit("No")), F.when(answer.isNotNull(), F.when(yes, 0).otherwise(1)))


def algebra() -> Converter:
    """Options that begin with their letter, which is taken off."""
    options = F.transform(strings("options"), lambda x: F.regexp_replace(strip(x), r"^[A-E][):][ \t\n]*", ""))
    return Converter(_name(None), F.concat(F.lit(PROBLEM), filled("question")), options, letter(F.upper(text("correct")), "E"))


def science() -> Converter:
    """Choices with labels that need not be letters; no row where the key is none of them."""
    return Converter(F.col("index").cast("string"), F.get_json_object("record", "$.question"), strings("choices.text"), F.array_position(strings("choices.label"), F.get_json_object("record", "$.answerKey")) - 1)


def subjects() -> Converter:
    return Converter(F.col("index").cast("string"), F.get_json_object("record", "$.question"), strings("choices"), whole("answer"))


def gaps() -> Converter:
    """A sentence with a gap and two fillings."""
    sentence = F.get_json_object("record", "$.sentence")
    fill = lambda n: F.replace(sentence, F.lit("_"), F.get_json_object("record", f"$.option{n}"))
    return Converter(F.col("index").cast("string"), F.when(sentence.isNotNull(), F.lit(GAP)), F.array(fill(1), fill(2)), F.when(F.get_json_object("record", "$.answer") == "1", 0).otherwise(1), SERVED_GAP)


def passages() -> Converter:
    premise = F.concat(F.lit("Passage: "), F.get_json_object("record", "$.passage"), F.lit("\nQuestion: "), F.get_json_object("record", "$.question"), F.lit("?"))
    return Converter(F.col("index").cast("string"), premise, F.array(*map(F.lit, TRUE_FALSE)), F.when(F.get_json_object("record", "$.answer") == "true", 0).otherwise(1), SERVED_PASSAGE)


def classes(before: str, options: list[str], served: str) -> Converter:
    """A text that belongs to one of a fixed list of classes."""
    return Converter(F.col("index").cast("string"), F.concat(F.lit(before), F.get_json_object("record", "$.text")), F.array(*map(F.lit, options)), whole("label"), served)


def tool_choices(records: DataFrame) -> DataFrame:
    """Whether to call a tool, ask back or answer: a row for each answer that isn't empty, right where equal to the correct one.

    A record with a parameter held out gives one more row: that its value was stated, which is wrong.
    """
    tools = F.substr(F.coalesce(F.get_json_object("record", "$.tools"), F.lit("null")), F.lit(1), F.lit(1200))
    premise = F.concat(F.substr(filled("question"), F.lit(1), F.lit(2500)), F.lit("\nAvailable tools: "), tools)
    answers = F.coalesce(strings("answers"), F.array(F.get_json_object("record", "$.answers")))
    d = records.select("index", premise.alias("premise"), answers.alias("answers"), F.coalesce(text("correct_answer"), F.lit("")).alias("correct"), filled("held_out_param").alias("held")).where("premise IS NOT NULL")
    options = d.select("index", "premise", "correct", F.explode("answers").alias("option")).withColumn("option", strip(F.coalesce("option", F.lit("None")))).where("option <> ''")
    options = options.select("index", "premise", F.concat(F.lit(ASSISTANT), F.substring("option", 1, 300)).alias("hypothesis"), (F.col("option") == F.col("correct")).cast("int").alias("label"), F.lit("when2call").alias("source"))
    held = d.where("held IS NOT NULL").select("index", "premise", F.concat(F.lit(HELD_OUT[0]), "held", F.lit(HELD_OUT[1])).alias("hypothesis"), F.lit(0).alias("label"), F.lit("when2call_param").alias("source"))
    return options.unionByName(held)


DECISION = "id string, domain string, context string, question string, options array<struct<key: string, text: string>>, gold_index int, gold_key string, soft_distribution array<double>"


def decisions(records: DataFrame) -> DataFrame:
    """Records to canonical decisions: options as text or as objects (text, else desc), keys A.. where none is given.

    With ``problem``: why a decision is refused (no or too many options, equal texts, gold outside), else null.
    """
    raw = strings("options")
    option = lambda x, i: F.struct(
        F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.key"), key(i))).otherwise(key(i)).alias("key"),
        F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.desc"), F.lit(""))).otherwise(x).alias("text"),
    )
    field = lambda n, other: F.coalesce(F.get_json_object("record", f"$.{n}"), other)
    d = records.select(
        F.get_json_object("record", "$.id").alias("id"), field("domain", F.lit("general")).alias("domain"), field("context", F.coalesce(F.get_json_object("record", "$.premise"), F.lit(""))).alias("context"),
        field("question", F.lit("")).alias("question"), F.transform(F.coalesce(raw, F.array()), option).alias("options"), F.coalesce(whole("gold_index"), F.lit(0)).alias("gold_index"),
        F.get_json_object("record", "$.gold_key").alias("gold_key"), F.from_json(F.get_json_object("record", "$.soft_distribution"), "array<double>").alias("soft_distribution"),
    )
    texts = F.transform("options", lambda o: o["text"])
    problem = F.when(~F.size("options").between(1, MOST_OPTIONS), "number of options").when(F.size(F.array_distinct(texts)) < F.size("options"), "equal options").when((F.col("gold_index") < 0) | (F.col("gold_index") >= F.size("options")), "gold outside")
    return d.withColumn("problem", problem).withColumn("gold_key", F.when(F.col("problem").isNull(), F.coalesce(F.nullif("gold_key", F.lit("")), F.get("options", F.col("gold_index"))["key"])))


def rotations(d: DataFrame, most: int | None = None) -> DataFrame:
    """The cyclic shifts of a decision: options and soft distribution turned, keys given anew, gold moved. One option: the decision itself."""
    k = F.size("options")
    d = d.where("problem IS NULL").withColumn("shift", F.explode(F.sequence(F.lit(0), F.least(k, F.lit(most or MOST_OPTIONS)) - 1)))
    turned = lambda c: F.concat(F.slice(c, F.col("shift") + 1, k), F.slice(c, 1, F.col("shift")))
    gold = F.pmod(F.col("gold_index") - F.col("shift"), k)
    many = k > 1
    options = F.transform(turned("options"), lambda o, i: F.struct(key(i).alias("key"), o["text"].alias("text")))
    return d.select(
        F.when(many, F.concat("id", F.lit("_perm_"), "shift")).otherwise(F.col("id")).alias("id"), "domain", "context", "question", F.when(many, options).otherwise(F.col("options")).alias("options"),
        gold.alias("gold_index"), F.when(many, key(gold)).otherwise(F.col("gold_key")).alias("gold_key"), F.when(F.size("soft_distribution") == k, turned("soft_distribution")).alias("soft_distribution"), "problem",
    )


def prompt(answer_slot: bool = True) -> Column:
    """A decision as a prompt: context, question, options by key, and a slot for the answer. Empty parts are left out."""
    part = lambda name, c: F.when(strip(F.col(c)) != "", F.concat(F.lit(f"{name}: "), strip(F.col(c))))
    options = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(": "), strip(o["text"]))), "\n")
    return F.concat_ws("\n", part("Context", "context"), part("Question", "question"), F.lit("Options:"), options, F.lit("Decision: ") if answer_slot else F.lit(None))


def decision_pairs(d: DataFrame) -> DataFrame:
    """A decision to one row an option; the soft target is the given one where its length fits."""
    d = d.where("problem IS NULL")
    premise = F.when(F.col("question") != "", F.concat(strip(F.col("context")), F.lit("\nQuestion: "), strip(F.col("question")))).otherwise(strip(F.col("context")))
    soft = F.when(F.size("soft_distribution") == F.size("options"), F.col("soft_distribution"))
    d = d.select("id", premise.alias("premise"), "gold_index", soft.alias("soft"), F.posexplode("options").alias("slot", "option"))
    right = F.col("slot") == F.col("gold_index")
    return d.select(F.concat("id", F.lit("_opt_"), "option.key").alias("id"), F.col("id").alias("group_id"), "premise", F.format_string("The correct answer is: %s: %s", "option.key", "option.text").alias("hypothesis"), right.cast("int").alias("label"), F.coalesce(F.get("soft", F.col("slot")), right.cast("double")).alias("soft_target"))


def option_texts() -> Column:
    """The options of a typed question (record: t, crit) in the order of their labels; noul is false, then true."""
    crit = F.get_json_object("record", "$.crit")
    choice = F.transform(F.map_entries(F.from_json(crit, "map<string,string>")), lambda e: F.when(F.coalesce(e["value"], F.lit("")) == "", e["key"]).otherwise(F.concat(e["key"], F.lit(": "), e["value"])))
    level = F.transform(F.from_json(crit, "array<string>"), lambda x, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), x))
    side = lambda name, other: F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.get_json_object("record", f"$.crit.{name}"), F.lit("")), F.lit(other)))
    kind = F.get_json_object("record", "$.t")
    return F.when(kind == "choice", choice).when(kind == "score", level).otherwise(F.array(*(side(*x) for x in NOUL.items())))
