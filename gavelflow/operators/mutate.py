"""Statements changed by rule, and statements made of questions, facts and calls: columns over columns.

Draws are by a hash of a key column, so a row is changed alike wherever and
whenever it is computed. Everything is a built-in function; nothing is shuffled
but where a query joins rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.operators.ranks import draw

#: Words that turn a statement round, tried in this order.
ANTONYMS = [("increased", "decreased"), ("decreased", "increased"), ("approved", "rejected"), ("rejected", "approved"), ("before", "after"), ("after", "before"), ("allowed", "forbidden"), ("supported", "opposed")]
DENIED = "Contrary to verified reports, it is not the case that "
#: Swaps of polarity.
POLARITY = [
    ("increased", "decreased"), ("decreased", "increased"), ("increase", "decrease"), ("decrease", "increase"), ("grew", "declined"), ("declined", "grew"), ("growth", "contraction"), ("exceeded", "fell short of"), ("fell short of", "exceeded"), ("higher", "substantially lower"),
    ("lower", "substantially higher"), ("more", "fewer"), ("fewer", "more"), ("majority", "minority"), ("minority", "majority"), ("supports", "refutes"), ("refutes", "supports"), ("supported", "refuted"), ("refuted", "supported"), ("enabled", "disabled"), ("disabled", "enabled"),
    ("enable", "disable"), ("disable", "enable"), ("allows", "prohibits"), ("prohibits", "allows"), ("allowed", "prohibited"), ("prohibited", "allowed"), ("polar", "nonpolar"), ("nonpolar", "polar"), ("synchronous", "asynchronous"), ("asynchronous", "synchronous"),
    ("maximizes", "minimizes"), ("minimizes", "maximizes"), ("maximum", "minimum"), ("minimum", "maximum"), ("right atrium", "left ventricle"), ("stratosphere", "troposphere"),
]
#: Swaps of names.
NAMES = [("Acme Corp", "Globex Corporation"), ("Globex Corp", "Acme Corporation"), ("Dublin", "Zurich"), ("Frankfurt", "Madrid"), ("Seattle", "Denver"), ("Denver", "Seattle"), ("Tokyo", "Osaka"), ("Miami", "Atlanta"), ("London", "Edinburgh"), ("Mars", "Venus"), ("Earth", "Jupiter")]


def has_word(x: Column, word: str) -> Column:
    return x.rlike(rf"(?i)\b{word}\b")


def swap_first(x: Column, word: str, other: str) -> Column:
    """The first place of a word, whatever its case, put another way."""
    return F.regexp_replace(x, F.lit(rf"(?is)^(.*?)\b{word}\b"), F.lit("$1" + other))


def corrupted(x: Column, key: Column) -> Column:
    """The first whole number gets 5, 10 or 100 more; else the first antonym that occurs is put; else the statement is denied.

    Numbers of more than 30 digits are left alone and count as none.
    """
    found = F.regexp_extract(x, r"\b(\d+)\b", 1)
    number = F.when(F.length(found).between(1, 30), found.cast("decimal(38,0)"))
    more = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(100)), draw(key, 3) + 1)
    out = F.when(number.isNotNull(), F.regexp_replace(x, F.lit(r"(?s)^(.*?)\b\d+\b"), F.concat(F.lit("$1"), (number + more).cast("string"))))
    for word, other in ANTONYMS:
        out = out.when(has_word(x, word), swap_first(x, word, other))
    return out.otherwise(F.concat(F.lit(DENIED), F.lower(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))


def _plain(x: Column) -> Column:
    """A number with at most one decimal, none where it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(F.round(x, 1).cast("string"))


def _percent(m: Column) -> Column:
    v = F.regexp_extract(m, r"^(\d+)", 1).try_cast("long")
    return F.concat(F.when(v > 15, F.greatest(F.lit(1), v - 10)).otherwise(v + 35).cast("string"), F.lit("%"))


def _money(m: Column) -> Column:
    v, unit = F.regexp_extract(m, r"^\$(\d+(?:\.\d+)?)", 1).try_cast("double"), F.regexp_extract(m, r"(?i)(billion|million|thousand)$", 1)
    return F.concat(F.lit("$"), _plain(F.when(v > 5, F.bround(v / 2, 1)).otherwise(F.bround(v * 4, 1))), F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise(F.lit("")))


def _year(m: Column) -> Column:
    v = m.try_cast("long")
    return F.when(v >= 2020, v - 3).otherwise(v + 5).cast("string")


def _integer(m: Column) -> Column:
    v = m.try_cast("long")
    return F.when(v > 30, F.floor(v / 3).cast("long")).otherwise(v * 3).cast("string")


#: The kinds of numbers, the first that occurs being changed: a pattern and what becomes of a match.
NUMBERS = [(r"\b\d{1,15}\s*%", _percent), (r"(?i)\$\d{1,15}(?:\.\d+)?(?:\s*(?:billion|million|thousand))?", _money), (r"\b(?:19\d{2}|20\d{2})\b", _year), (r"\b\d{2,15}\b", _integer)]


def with_number(d: DataFrame, x: Column, key: Column, out: str) -> DataFrame:
    """One of the numbers of the first kind that occurs, drawn, put wrong; null where there is none.

    Each step is a column of its own, so that a text is searched once a kind; pieces between matches are put together again.
    """
    kind, patterns = None, F.array(*(F.lit(p) for p, _ in NUMBERS))
    for i, (pattern, _) in enumerate(NUMBERS):
        found = x.rlike(pattern)
        kind = F.when(found, i) if kind is None else kind.when(found, i)
    d = d.withColumn("__kind", kind).withColumn("__pattern", F.get(patterns, F.col("__kind")))
    d = d.withColumn("__matches", F.regexp_extract_all(x, F.concat(F.lit("("), "__pattern", F.lit(")")), F.lit(1))).withColumn("__pieces", F.split(x, F.col("__pattern"), F.lit(-1)))
    d = d.withColumn("__which", draw(F.concat(key, F.lit(":number")), F.greatest(F.size("__matches"), F.lit(1)))).withColumn("__match", F.get("__matches", F.col("__which")))
    new = F.when(F.col("__kind") == 0, _percent(F.col("__match")))
    for i, (_, by) in enumerate(NUMBERS[1:], 1):
        new = new.when(F.col("__kind") == i, by(F.col("__match")))
    d = d.withColumn("__new", new)
    parts = F.transform("__matches", lambda m, i: F.concat(F.get("__pieces", i), F.when(i == F.col("__which"), F.col("__new")).otherwise(m)))
    return d.withColumn(out, F.concat(F.array_join(parts, ""), F.get("__pieces", F.size("__matches")))).drop("__kind", "__pattern", "__matches", "__pieces", "__which", "__match", "__new")


def with_swap(d: DataFrame, x: Column, pairs: list[tuple[str, str]], key: Column, out: str) -> DataFrame:
    """One of the swaps that apply, drawn, at its first place; null where none does."""
    d = d.withColumn("__fit", F.filter(F.array(*(F.when(has_word(x, word), F.lit(i)) for i, (word, _) in enumerate(pairs))), lambda i: i.isNotNull()))
    d = d.withColumn("__chosen", F.get("__fit", draw(F.concat(key, F.lit(":swap")), F.greatest(F.size("__fit"), F.lit(1)))))
    swap = F.when(F.col("__chosen") == 0, swap_first(x, *pairs[0]))
    for i, pair in enumerate(pairs[1:], 1):
        swap = swap.when(F.col("__chosen") == i, swap_first(x, *pair))
    return d.withColumn(out, swap).drop("__fit", "__chosen")


def counterfactual(df: DataFrame, text: str, key: Column) -> DataFrame:
    """Rows of df whose statement can be turned round, with ``flipped`` and ``axis``: number, polarity and name are tried in a drawn order."""
    x = F.col(text)
    d = with_swap(with_swap(with_number(df, x, key, "__number"), x, POLARITY, key, "__polarity"), x, NAMES, key, "__name").withColumn("__order", draw(F.concat(key, F.lit(":axis")), 6))
    for a in ("number", "polarity", "name"):
        d = d.withColumn(f"__{a}", F.when(F.col(f"__{a}") != x, F.struct(F.lit(a).alias("axis"), F.col(f"__{a}").alias("flipped"))))
    orders = [(a, b, c) for a in ("number", "polarity", "name") for b in ("number", "polarity", "name") for c in ("number", "polarity", "name") if len({a, b, c}) == 3]
    found = F.when(F.col("__order") == 0, F.coalesce(*(F.col(f"__{a}") for a in orders[0])))
    for i, order in enumerate(orders[1:], 1):
        found = found.when(F.col("__order") == i, F.coalesce(*(F.col(f"__{a}") for a in order)))
    # the filter must not be pushed below, where it would bring all of these columns with it, again for every use
    d = d.withColumn("__found", found).withColumn("__found", F.explode_outer(F.array("__found"))).where("__found IS NOT NULL")
    return d.select(*df.columns, F.col("__found.axis").alias("axis"), F.col("__found.flipped").alias("flipped"))


def statement(question: Column, answer: Column, kind: Column) -> Column:
    """A question and its answer as a claim, by five rules; struct(claim, flips): whether "no" makes the same claim wrong."""
    q = F.trim(F.regexp_replace(F.trim(question), r"\?+$", ""))
    low, a = F.lower(q), F.lower(F.trim(answer))
    say = lambda claim, flips=False: F.struct(claim.alias("claim"), F.lit(flips).alias("flips"))
    colour = F.regexp_extract(low, r"^what colou?r (?:is|are) (?:the )?(.+)$", 1)
    noun = F.trim(F.regexp_replace(F.regexp_extract(low, r"^how many (.+)$", 1), r"\b(are|is|can|do|does|there|in|on|the|this|that|photo|picture|image)\b.*$", ""))
    named = F.create_map(*(F.lit(x) for p in zip("012345", ("no", "one", "two", "three", "four", "five")) for x in p))
    words = F.coalesce(F.try_element_at(named, a), a)
    verb, rest = F.regexp_extract(low, r"^(is|are|was|were|does|do|did|can|has|have|will)\s+(.+)$", 1), F.regexp_extract(low, r"^(is|are|was|were|does|do|did|can|has|have|will)\s+(.+)$", 2)
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    yes_no, being, two = kind == "yes/no", verb.isin("is", "are", "was", "were"), F.instr(rest, " ") > 0
    return (
        F.when(colour != "", say(F.concat(F.lit("The "), colour, F.lit(" is "), a, F.lit("."))))
        .when(noun != "", say(F.concat(F.lit("There are "), words, F.lit(" "), noun, F.lit(" in the image."))))
        .when(yes_no & being & two, say(F.concat(capital(F.regexp_extract(rest, r"^([^ ]*) ", 1)), F.lit(" "), verb, F.lit(" "), F.regexp_extract(rest, r"^[^ ]* (.*)$", 1), F.lit(".")), True))
        .when(yes_no & (verb != "") & ~being, say(F.concat(capital(rest), F.lit(" ("), verb, F.lit(").")), True))
        .when(yes_no, say(F.concat(F.lit('The answer to "'), q, F.lit('?" is '), a, F.lit("."))))
        .otherwise(say(F.concat(F.lit('In this image, the answer to "'), q, F.lit('?" is '), a, F.lit("."))))
    )


def haystack(pairs: DataFrame, pool: DataFrame, few: int, many: int, drop: float, corrupt: float) -> DataFrame:
    """pairs (id, premise, hypothesis, label) -> id, label, kind, paragraphs, doc: the premise in a stack of other paragraphs.

    pool: one row with an array ``fillers`` of bounded size, broadcast. A part ``drop`` of the premises is left out (open);
    up to ``corrupt`` a premise that supports its claim is put wrong (contradicts); premises that contradict
    theirs are left out as well, for a claim about another scene isn't refuted by a long document; the rest stay.
    """
    key = F.concat(F.lit("hay:"), F.col("id").cast("string"))
    roll = draw(F.concat(key, F.lit(":roll")), 1000) / 1000
    n = F.least(F.lit(few) + draw(F.concat(key, F.lit(":n")), many - few + 1), F.size("fillers"))
    kind = F.when(roll < drop, "drop").when((roll < corrupt) & (F.col("label") == 1), "corrupt").when((F.col("label") == 0) & F.lit(corrupt > drop), "drop").otherwise("embed")
    d = pairs.crossJoin(F.broadcast(pool)).withColumn("kind", kind).withColumn("n", n).withColumn("start", draw(F.concat(key, F.lit(":start")), F.greatest(F.size("fillers"), F.lit(1))))  # one row
    around = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("fillers", (F.col("start") + k) % F.size("fillers")))
    d = d.where("size(fillers) > 0").withColumn("around", around).withColumn("place", draw(F.concat(key, F.lit(":place")), F.col("n") + 1))
    needle = F.when(F.col("kind") == "corrupt", corrupted(F.col("premise"), key)).otherwise(F.col("premise"))
    inside = F.concat(F.slice("around", 1, F.col("place")), F.array(needle), F.slice("around", F.col("place") + 1, F.col("n")))
    d = d.withColumn("doc", F.when(F.col("kind") == "drop", F.col("around")).otherwise(inside))
    label = F.when(F.col("kind") == "drop", 2).when(F.col("kind") == "corrupt", 0).otherwise(F.col("label"))
    return d.select("id", label.cast("int").alias("label"), "kind", F.size("doc").alias("paragraphs"), F.array_join("doc", "\n\n").alias("doc"))
