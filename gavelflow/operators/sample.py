"""Sampling, balancing, capping and splitting of tables, DataFrame in and DataFrame out.

Every draw is an order by md5("seed:key"), so it does not depend on how the
table is dealt out. Ranks come from the two-level operator; a first n of the
whole table is a sort with a limit, which keeps n rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.operators.ranks import by_hash, ranked

H = "__h"


def seeded(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def drawn(df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None, rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with the place of each row in the seeded order, of all or of its group, and how many rows these are."""
    return ranked(df.withColumn(H, seeded(key, seed)), by_hash(H), [H, key], by=by, rank=rank, size=size).drop(H)


def take(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.withColumn(H, seeded(key, seed)).orderBy(H, key).limit(n).drop(H)


def balanced(df: DataFrame, label: str, key: str, n: int, classes: int = 3, seed: int = 42) -> DataFrame:
    """floor(n / classes) rows of each label, or all there are."""
    return drawn(df, key, seed, [label]).where(F.col("rank") <= n // classes).drop("rank")


def balance_to_least(df: DataFrame, label: str, key: str, factor: float = 1.15, seed: int = 42) -> DataFrame:
    """At most factor times as many rows of a label as of the rarest."""
    least = F.broadcast(df.groupBy(label).count().agg(F.floor(F.lit(factor) * F.min("count")).alias("__most")))  # one row
    return drawn(df, key, seed, [label]).crossJoin(least).where(F.col("rank") <= F.col("__most")).drop("rank", "__most")


def cap(df: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group in the order; groups may be many or large: a top-n window keeps n rows a group and task before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def split(df: DataFrame, key: str, part: float, least: int = 1, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """df with ``part``: val for the first max(least, floor(part x rows)) rows in the seeded order, of all or of each group; else train."""
    d = drawn(df, key, seed, by, size="__of")
    return d.withColumn("part", F.when(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("__of") * part)), "val").otherwise("train")).drop("rank", "__of")


def budget(df: DataFrame, size: str, key: str, most: int, crossing: bool, seed: int = 42) -> DataFrame:
    """Rows in the seeded order while the running sum of size is within ``most``; with ``crossing`` the row that passes it as well."""
    d = ranked(df.withColumn(H, seeded(key, seed)), by_hash(H), [H, key], value=F.col(size), before="__before").drop(H, "rank")
    return d.where((F.col("__before") < most) if crossing else (F.col("__before") + F.col(size) <= most)).drop("__before")


def oversample(df: DataFrame, key: str, which: Column, times: int) -> DataFrame:
    """Rows that hold come ``times`` times, copies with _rep and their number at the key."""
    d = df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.when(which, times - 1).otherwise(0))))
    return d.withColumn(key, F.when(F.col("__copy") == 0, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("_rep"), "__copy"))).drop("__copy")
