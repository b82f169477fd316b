"""How queries are registered: SQL that Spark runs, and the same statement for the oracle.

A query is written once as a function of a dialect; the few expressions whose
spelling differs come from the dialect. Relations that the queries share
(``FIXTURES``) are put in front as common table expressions when named. Spark
sees one declarative statement, so its optimiser prunes and pushes down all of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow import registry
from gavelflow.operators.ranks import by_hash, by_value, ranked

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


class Spark:
    name = "spark"

    def rx(self, x, pattern, by):
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    def sha256(self, x):
        return f"sha2({x}, 256)"

    def json(self, x, key):
        return f"get_json_object({x}, '$.{key}')"

    def at(self, x, i):
        """Element i, from 0; null when there is none."""
        return f"get({x}, {i})"

    def seq(self, n, i="i"):
        return f"(SELECT id AS {i} FROM range({n}))"

    def explode(self, x, i="i", v="v"):
        return f"LATERAL VIEW posexplode({x}) AS {i}, {v}"

    def arr(self, *x):
        return f"array({', '.join(x)})"

    def split(self, x, pattern):
        return f"split({x}, r'{pattern}')"

    def matches(self, x, pattern):
        return f"{x} rlike r'{pattern}'"

    def extract(self, x, pattern, group=1):
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def collect(self, x, order):
        """The values of x in the order given, joined by '|'."""
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, cast({x} AS string) AS v))), s -> s.v), '|')"

    def quantile(self, x, p):
        return f"percentile({x}, {p})"

    def size(self, x):
        return f"size({x})"

    def epoch(self, x):
        return f"unix_timestamp(cast({x} AS timestamp))"

    def latest(self, table, keys, order):
        """Of each key the row of the highest order: a maximum, so that it is combined before rows are shuffled."""
        return f"(SELECT _r.* FROM (SELECT max_by(struct(_t.*), {order}) AS _r FROM {table} AS _t GROUP BY {keys}) AS _m)"

    def earliest(self, table, keys, order):
        return f"(SELECT _r.* FROM (SELECT min_by(struct(_t.*), {order}) AS _r FROM {table} AS _t GROUP BY {keys}) AS _m)"

    def draw(self, x, n):
        """A number from 0 to n - 1, by a hash of x."""
        return f"CAST(pmod(CAST(conv(substr(md5({x}), 1, 7), 16, 10) AS bigint), {n}) AS int)"

    def pick(self, items, i):
        """Element i of fixed values."""
        return self.at(self.arr(*map(literal, items)), i)

    def commas(self, x):
        return f"format_number({x}, 0)"

    def tenths(self, x):
        return f"format_number({x}, 1)"

    def map(self, x, v, e):
        """e of each element v of an array."""
        return f"transform({x}, {v} -> {e})"

    def keep(self, x, v, e):
        return f"filter({x}, {v} -> {e})"

    def upto(self, n):
        """The numbers from 0 to n - 1, n at least 1."""
        return f"sequence(0, CAST({n} AS int) - 1)"

    def cut(self, x, begin, n):
        """n elements from place begin (from 0) on."""
        return f"slice({x}, CAST({begin} AS int) + 1, CAST({n} AS int))"

    def cat(self, *xs):
        return f"concat({', '.join(xs)})"

    def joined(self, x, by):
        return f"array_join({x}, {by})"

    def listed(self, x, order):
        """The values of x as an array in the order given."""
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), s -> s.v)"

    def object(self, **fields):
        """A JSON object of text fields."""
        return f"to_json(named_struct({', '.join(f'{literal(k)}, {v}' for k, v in fields.items())}))"

    def span(self, x, pattern, group):
        """A group of the first match; a dot is any character."""
        return f"regexp_extract({x}, concat('(?s)', r'{pattern}'), {group})"

    def weekday(self, x):
        """0 for Monday."""
        return f"weekday({x})"

    def days(self, x, n):
        return f"date_add({x}, CAST({n} AS int))"

    def moment(self, x, minutes):
        """The time so many minutes after the beginning of a date."""
        return f"timestampadd(MINUTE, CAST({minutes} AS int), CAST({x} AS timestamp_ntz))"

    def stamp(self, x):
        return f"""date_format({x}, "EEEE, MMMM dd 'at' HH:mm 'UTC'")"""

    def first(self, x, pattern, by):
        """The first match, whatever its case, replaced."""
        return f"regexp_replace({x}, concat('(?is)^(.*?)', r'{pattern}'), concat('$1', {by}))"

    def has(self, x, pattern):
        return f"{x} rlike concat('(?i)', r'{pattern}')"


class Duck(Spark):
    name = "duck"

    def latest(self, table, keys, order):
        return f"(SELECT * FROM {table} AS _t QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) = 1)"

    def earliest(self, table, keys, order):
        return f"(SELECT * FROM {table} AS _t QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)"

    def draw(self, x, n):
        return f"CAST(CAST(concat('0x', substr(md5({x}), 1, 7)) AS bigint) % {n} AS int)"

    def map(self, x, v, e):
        return f"list_transform({x}, lambda {v}: {e})"

    def keep(self, x, v, e):
        return f"list_filter({x}, lambda {v}: {e})"

    def upto(self, n):
        return f"range(0, CAST({n} AS bigint))"

    def cut(self, x, begin, n):
        return f"({x})[CAST({begin} AS bigint) + 1 : CAST({begin} AS bigint) + CAST({n} AS bigint)]"

    def cat(self, *xs):
        return f"({' || '.join(xs)})"

    def joined(self, x, by):
        return f"array_to_string({x}, {by})"

    def listed(self, x, order):
        return f"list({x} ORDER BY {order})"

    def object(self, **fields):
        return f"CAST(json_object({', '.join(f'{literal(k)}, {v}' for k, v in fields.items())}) AS varchar)"

    def span(self, x, pattern, group):
        return f"regexp_extract({x}, '{pattern}', {group}, 's')"

    def commas(self, x):
        return f"format('{{:,}}', CAST({x} AS bigint))"

    def tenths(self, x):
        return f"format('{{:.1f}}', CAST({x} AS double))"

    def weekday(self, x):
        return f"(isodow({x}) - 1)"

    def days(self, x, n):
        return f"CAST({x} + CAST({n} AS int) AS date)"

    def moment(self, x, minutes):
        return f"(CAST({x} AS timestamp) + to_minutes(CAST({minutes} AS bigint)))"

    def stamp(self, x):
        return f"strftime({x}, '%A, %B %d at %H:%M UTC')"

    def first(self, x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', {by}, 'i')"

    def has(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}', 'i')"

    def rx(self, x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def sha256(self, x):
        return f"sha256({x})"

    def json(self, x, key):
        return f"json_extract_string({x}, '$.{key}')"

    def at(self, x, i):
        return f"({x})[({i}) + 1]"

    def seq(self, n, i="i"):
        return f"(SELECT range AS {i} FROM range({n}))"

    def explode(self, x, i="i", v="v"):
        return f", LATERAL (SELECT unnest({x}) AS {v}, unnest(range(0, len({x}))) AS {i}) AS _x"

    def arr(self, *x):
        return f"[{', '.join(x)}]"

    def split(self, x, pattern):
        return f"regexp_split_to_array({x}, '{pattern}')"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x, pattern, group=1):
        return f"regexp_extract({x}, '{pattern}', {group})"

    def collect(self, x, order):
        return f"string_agg(cast({x} AS varchar), '|' ORDER BY {order})"

    def quantile(self, x, p):
        return f"quantile_cont({x}, {p})"

    def size(self, x):
        return f"len({x})"

    def epoch(self, x):
        return f"cast(floor(epoch({x})) AS bigint)"


SPARK, DUCK = Spark(), Duck()

#: Shared relations, built from the driver's tables.
FIXTURES: dict[str, Callable[[Spark], str]] = {
    "pair": lambda d: """SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS premise, trim(substr(d.text, length(split_part(d.text, chr(10), 1)) + 2)) AS hypothesis,
        coalesce(l.quality, 2) AS label, d.source, d.lang AS language, d.doc_id AS ord FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "grouped": lambda d: """SELECT l_orderkey AS group_id, l_linenumber AS k, l_orderkey * 10 + l_linenumber AS ord, l_partkey AS part, l_extendedprice AS score, l_discount AS soft, l_quantity AS qty,
        CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1 THEN 1 ELSE 0 END AS is_gold FROM lineitem""",
    "ballot": lambda d: f"""SELECT event_id AS seq, event_id % 500 AS sample, event_type AS judge, CAST({d.json('props', 'k')} AS int) % 3 AS label,
        CASE WHEN event_type = 'error' THEN 'offline' ELSE 'ok' END AS status, value AS latency, ts, event_id % 4 AS run FROM events""",
    "verdict": lambda d: f"SELECT seq, sample, judge, label, status, latency, ts, run, sample % 3 AS gen FROM {d.latest('ballot', 'sample, judge', 'seq')} AS v",
    "tally": lambda d: """SELECT sample, min(gen) AS gen, count(*) AS judges, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'ok' AND label = 0) AS c0,
        count(*) FILTER (WHERE status = 'ok' AND label = 1) AS c1, count(*) FILTER (WHERE status = 'ok' AND label = 2) AS c2 FROM verdict GROUP BY sample""",
    "logit": lambda d: f"""SELECT vec_id AS id, label % 3 AS gold, label AS slice, {', '.join(f"CAST({d.at('embedding', i)} AS double) AS z{i}" for i in range(6))} FROM embeddings""",
    "item": lambda d: """SELECT id, gold, slice, exp(z0) / (exp(z0) + exp(z1) + exp(z2)) AS p0, exp(z1) / (exp(z0) + exp(z1) + exp(z2)) AS p1, exp(z2) / (exp(z0) + exp(z1) + exp(z2)) AS p2,
        exp(z3) / (exp(z3) + exp(z4) + exp(z5)) AS q0, exp(z4) / (exp(z3) + exp(z4) + exp(z5)) AS q1, exp(z5) / (exp(z3) + exp(z4) + exp(z5)) AS q2 FROM logit""",
    "scored": lambda d: """SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred, greatest(p0, p1, p2) AS conf,
        CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS pred_b, greatest(q0, q1, q2) AS conf_b FROM item""",
}


#: Relations that Spark gets from operators instead of the fixture of the same name, as SQL would do all of it in one task.
OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def expand(body: str, d: Spark) -> str:
    """body with the fixtures it names, and those that they name, in front."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for name, make in FIXTURES.items():
            if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql) and name not in need and not (d is SPARK and name in OPERATORS):
                visit(make(d))
                need.append(name)

    visit(body)
    ctes = ", ".join(f"{n} AS ({FIXTURES[n](d)})" for n in need)
    if not ctes:
        return body
    return f"WITH {ctes}, {body.lstrip()[4:]}" if body.lstrip().upper().startswith("WITH ") else f"WITH {ctes} {body}"


def tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def rank_relation(name: str, inner: str, order: str, value: str | None = None, by: str | None = None, rank: str = "k", size: str = "q", before: str | None = None, adds: str = "1", total: str | None = None, falling: bool = False) -> None:
    """A relation: inner with rank (from 1) by ``order``, within groups of ``by``; size of the group; before and total: sums of ``adds``.

    The oracle gets window functions, Spark the two-level operator: by the digits of the column h, or by quantiles of ``value``.
    """
    over = f"({f'PARTITION BY {by} ' if by else ''}ORDER BY {order}"
    every = f"({f'PARTITION BY {by}' if by else ''})"
    sums = (f", sum({adds}) OVER {over} ROWS UNBOUNDED PRECEDING) - ({adds}) AS {before}" if before else "") + (f", sum({adds}) OVER {every} AS {total}" if total else "")
    FIXTURES[name] = lambda d: f"SELECT *, row_number() OVER {over}) AS {rank}, count(*) OVER {every} AS {size}{sums} FROM ({inner(d)}) AS _i"

    def make(spark, sf):
        d = spark_sql(spark, sf, expand(inner(SPARK), SPARK))
        bucket = by_value(d, value, falling=falling) if value else by_hash("h")
        return ranked(d, bucket, [F.expr(x.removesuffix(" DESC")).desc() if x.endswith(" DESC") else F.expr(x) for x in order.split(", ")], by=[by] if by else None, value=F.expr(adds), rank=rank, before=before, size=size, total=total)

    OPERATORS[name] = make


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a statement for Spark over the tables and the operators' relations that it names."""
    tables(spark, sf_dir, text)
    for name, make in OPERATORS.items():
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
            make(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(text)


def sql(name: str, make: Callable[[Spark], str]) -> None:
    """Register a query written for both dialects."""
    text = expand(make(SPARK), SPARK)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark_sql(spark, sf_dir, text)

    query(name, run, expand(make(DUCK), DUCK))


def query(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Register a query built by DataFrame operators, with SQL for the oracle where SQL can say it."""
    if name in registry.QUERIES:
        raise ValueError(f"{name} is registered twice")
    registry.QUERIES[name] = run
    if oracle:
        registry.SQL[name] = oracle
