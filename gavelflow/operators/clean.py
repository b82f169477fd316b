"""Cleaning of pair tables, DataFrame in and DataFrame out: deduplicated splits, contamination against a test set, and checks that raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(x: str) -> Column:
    """Lower case, blanks run together."""
    return F.trim(F.regexp_replace(F.lower(F.col(x)), r"[ \n]+", " "))


def pair_key(premise: str = "premise", hypothesis: str = "hypothesis", image: str | None = None) -> Column:
    """SHA-1 of both texts normalised, and the picture if there is one: rows with one premise template differ by their picture."""
    key = F.sha1(F.concat(normalised(premise), F.lit("\x1f"), normalised(hypothesis)))
    return F.concat(key, F.lit("\x1f"), F.coalesce(F.col(image), F.lit(""))) if image else key


def dedupe_split(train: DataFrame, val: DataFrame, order: str, key: Column) -> DataFrame:
    """All rows of both with ``part`` and ``kept``: the first of its key in train; in val the first of a key that train does not have."""
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val"))).withColumn("__key", key)
    first = both.groupBy("__key").agg(F.min(F.struct(F.col("part").alias("p"), F.col(order).alias("o"))).alias("__first"))  # train sorts before val
    return both.join(first, "__key").withColumn("kept", (F.col("part") == F.col("__first.p")) & (F.col(order) == F.col("__first.o"))).drop("__key", "__first")


def clean_stage(train: DataFrame, val: DataFrame, test: DataFrame, order: str, exempt: str, premise: str = "premise", hypothesis: str = "hypothesis", source: str = "source") -> DataFrame:
    """All rows of train and val with ``part`` and ``outcome``.

    A row goes if its pair is in test, or its premise is (but for the source ``exempt``, whose premises are
    templates); a later copy within its part goes; a row of val goes if a kept row of train has its pair.
    """
    key = F.struct(F.trim(premise).alias("p"), F.trim(hypothesis).alias("h"))
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val"))).withColumn("__key", F.sha2(F.concat_ws("\x1f", key["p"], key["h"]), 256)).withColumn("__premise", F.sha2(F.trim(premise), 256))
    pairs = test.select(F.sha2(F.concat_ws("\x1f", F.trim(premise), F.trim(hypothesis)), 256).alias("__key")).distinct().withColumn("__pair", F.lit(True))
    premises = test.select(F.sha2(F.trim(premise), 256).alias("__premise")).distinct().withColumn("__seen", F.lit(True))
    both = both.join(pairs, "__key", "left").join(premises, "__premise", "left")
    over = F.col("__pair").isNotNull() | (F.col("__seen").isNotNull() & ~F.coalesce(F.col(source) == exempt, F.lit(False)))
    both = both.withColumn("__over", over)
    first = both.where("NOT __over").groupBy("__key").agg(F.min(F.when(F.col("part") == "train", F.col(order))).alias("__train"), F.min(F.when(F.col("part") == "val", F.col(order))).alias("__val"))
    both = both.join(first, "__key", "left")
    outcome = F.when(F.col("__over"), "test overlap").when((F.col("part") == "val") & F.col("__train").isNotNull(), "train overlap").when(F.col(order) > F.when(F.col("part") == "train", F.col("__train")).otherwise(F.col("__val")), "internal duplicate").otherwise("kept")
    return both.withColumn("outcome", outcome).drop("__key", "__premise", "__pair", "__seen", "__over", "__train", "__val")


def purge_non_ok(verdicts: DataFrame, judge: str | None = None, run: int | None = None) -> DataFrame:
    """verdicts without the failed ones of a judge, of a run, or of a judge in a run; an error where neither is given."""
    if judge is None and run is None:
        raise ValueError("give a judge, a run, or both")
    scope = F.col("status") != "ok"
    for name, value in (("judge", judge), ("run", run)):
        if value is not None:
            scope = scope & (F.col(name) == value)
    return verdicts.where(~F.coalesce(scope, F.lit(False)))


def assert_allowed(used: DataFrame, banned: DataFrame) -> DataFrame:
    """used (repo, split), or an error that names those which banned (repo, split; * for all splits) forbids."""
    b = banned.select(F.col("repo").alias("__repo"), F.col("split").alias("__split"))
    bad = used.join(F.broadcast(b), (F.col("repo") == F.col("__repo")) & ((F.col("__split") == "*") | (F.col("split") == F.col("__split")))).select("repo", "split").distinct().limit(20).collect()
    if bad:
        raise ValueError("banned: " + ", ".join(f"{r['repo']}/{r['split']}" for r in bad))
    return used


def assert_min(df: DataFrame, column: str, least: dict) -> DataFrame:
    """df, or an error that names the values of column with fewer rows than asked for."""
    have = {r[0]: r[1] for r in df.where(F.col(column).isin(list(least))).groupBy(column).count().collect()}  # as many rows as values asked for
    short = {k: have.get(k, 0) for k, n in least.items() if have.get(k, 0) < n}
    if short:
        raise ValueError(f"too few rows of {column}: {short}")
    return df


def assert_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """df, or an error that counts rows whose value of column is not allowed (nulls are not)."""
    bad = df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rows with {column} outside {allowed}")
    return df
