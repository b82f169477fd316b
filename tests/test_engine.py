"""The engine without its training-data part: registered queries against their SQL, operators and invariants."""

import collections
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gavelflow import registry
from gavelflow.functions import erfc, option_code
from gavelflow.operators import decontam, packing
from gavelflow.plans import base
from gavelflow.sources import readers, sinks
from gavelflow.streaming import verdicts

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in base.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.SQL[name])
    at = [want.columns.index(c) for c in names]
    assert collections.Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == collections.Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


WHOLE = {"typed_noul": None, "typed_ingest": "group_id", "cyclic_permutations": "group_id", "incontext_prompt": "group_id", "scenario_pairs": "group_id", "remediation_pairs": "group_id", "group_to_v2": "group_id", "systemone_format": "group_id", "adjacency": None}


def test_whole_tables(spark):
    """Queries over groups leave out no order, however large its key."""
    lines = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect():
        lines[r[0]].append(r[1])
    many, some = {g for g, k in lines.items() if len(k) > 1}, set(lines)
    want = {"typed_noul": 2 * sum(map(len, lines.values())), "adjacency": sum(len(k) ** 2 for k in lines.values()), "cyclic_permutations": sum(len(k) ** 2 for k in lines.values())}
    for name, key in WHOLE.items():
        got = registry.QUERIES[name](spark, SF01)
        if key:
            assert {r[0] for r in got.select(key).distinct().collect()} == (many if name in ("scenario_pairs", "remediation_pairs", "group_to_v2") else some), name
        assert got.count() == want.get(name, got.count()), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_groups_stay_whole(spark):
    parts = registry.QUERIES["split_grouped_strat"](spark, SF)
    assert parts.groupBy(F.floor(F.col("id") / 4)).agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_pack_budget(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(1, 60)) for i, g in enumerate(rng.choices(range(80), k=400))]
    out = packing.group_pack(spark.createDataFrame(rows, "g long, o long, n int"), "g", "o", "n", 500).collect()
    batch = {r["g"]: r["batch"] for r in out}
    assert set(batch) == {g for g, _, _ in rows}
    for b in set(batch.values()):
        own = [r for r in rows if batch[r[0]] == b]
        assert max(r[2] for r in own) * len(own) <= 500 or len({r[0] for r in own}) == 1


def test_functions(spark):
    xs = [0.0, 0.1, 0.9, 1.99, 2.0, 3.5, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r["y"], math.erfc(x), rel_tol=1e-9, abs_tol=1e-12) for x, r in zip(xs, got))
    assert [r[0] for r in spark.range(0, 28).orderBy("id").select(option_code(F.col("id"))).collect()][-3:] == ["Z", "AA", "AB"]


def test_readers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.required(spark, str(tmp_path / "none"), "a int")
    with pytest.raises(ValueError):
        readers.resolve_columns(spark.createDataFrame([], "x int"))
    assert readers.resolve_columns(spark.createDataFrame([], "Claim string, CONTEXT string, label int, z int")).columns == ["premise", "hypothesis", "label", "z"]
    (tmp_path / "d.json").write_text('{"data": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]}')
    (tmp_path / "l.json").write_text('[{"a": 3, "b": "z"}]')
    assert readers.json_document(spark, str(tmp_path / "d.json"), "a int, b string").count() == 2
    assert readers.json_document(spark, str(tmp_path / "l.json"), "a int, b string").count() == 1
    assert "| a |" in sinks.markdown(spark.createDataFrame([(1,)], "a int"))


def test_databases(spark, tmp_path):
    """Several files, a table that is empty, nulls, and a table too large for the driver's file."""
    d = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    (tmp_path / "dbs").mkdir()
    sinks.sqlite(d, str(tmp_path / "dbs" / "one.db"), "t")
    sinks.sqlite(d.limit(0), str(tmp_path / "dbs" / "none.db"), "t")
    sinks.sqlite(d.where("k = 2"), str(tmp_path / "dbs" / "two.db"), "t")
    got = readers.sqlite(spark, str(tmp_path / "dbs"), "SELECT k, v FROM t WHERE k > 0", "k long, v string").collect()
    assert collections.Counter(map(tuple, got)) == {(1, "a"): 1, (2, None): 2}
    with pytest.raises(ValueError):
        sinks.sqlite(d, str(tmp_path / "big.db"), "t", most=1)


def test_ngrams_at_the_edges(spark):
    t = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "a b c a b c")], "k int, text string")
    got = {r["k"]: r["grams"] for r in decontam.with_grams(t, decontam.ws_words, 3).collect()}
    assert not got[1] and not got[2] and not got[3] and got[4] == ["a b c", "b c a", "c a b"]
    whole = {r["k"]: r["grams"] for r in decontam.with_grams(t, decontam.alnum_words, 3, True).collect()}
    assert whole[3] == ["a b"]


def test_early_exit_needs_two_equal_votes():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, v):
            self.exists, self.get = True, v

    rows = pd.DataFrame([(1, "a", 1, "ok"), (2, "b", 1, "offline"), (3, "c", 1, "ok"), (4, "d", 0, "ok")], columns=["seq", "judge", "label", "status"])
    out = next(verdicts.settle()((7,), iter([rows]), State()))
    assert out["seq"].tolist() == [1, 2, 3] and out["settled"].tolist() == [False, False, True]
