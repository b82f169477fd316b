"""Evaluation statistics over DataFrames of predictions: calibration error by the bins in use, accuracy, decisions from option scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_closed(conf: Column, bins: int) -> Column:
    """Bins closed above; the first holds zero as well."""
    return F.greatest(F.ceil(conf * bins) - 1, F.lit(0))


def bin_open(conf: Column, bins: int) -> Column:
    """Bins closed above; zero is in none."""
    return F.when(conf > 0, F.ceil(conf * bins) - 1)


def bin_floor(conf: Column, bins: int) -> Column:
    return F.least(F.floor(conf * bins), F.lit(bins - 1))


def bin_third(conf: Column, bins: int) -> Column:
    """Bins from a third, the least confidence of three classes, to one."""
    return F.least(F.floor((F.greatest(conf, F.lit(1 / 3)) - 1 / 3) / (2 / 3 / bins)), F.lit(bins - 1))


def ece(df: DataFrame, conf: str, correct: Column, bins: int = 15, rule=bin_closed, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Expected calibration error, and how many bins are in use; per group of ``by``."""
    by = by or []
    b = df.withColumn("__bin", rule(F.col(conf), bins)).where("__bin IS NOT NULL").groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("acc"), F.avg(conf).alias("mean"))
    return b.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("mean"))) / F.sum("n"), digits).alias("ece"), F.count(F.lit(1)).alias("used"))


def accuracy(df: DataFrame, correct: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))


def decide(options: DataFrame, group: str, score: str, order: str, temperature: float = 1.0) -> DataFrame:
    """Of each group the option of the highest score (the first by ``order`` of equal ones) with its softmax probability. A maximum, so it combines before rows are shuffled."""
    shifted = F.col(score) / temperature
    best = options.groupBy(group).agg(F.max(shifted).alias("__top"), F.max_by(F.struct(*options.columns), F.struct(shifted, -F.col(order))).alias("__best"))
    mass = options.join(best.select(group, "__top"), group).groupBy(group).agg(F.sum(F.exp(shifted - F.col("__top"))).alias("__mass"))
    return best.join(mass, group).select("__best.*", (1 / F.col("__mass")).alias("probability"))


def rerank(options: DataFrame, group: str, score: str, order: str, temperature: float = 1.0) -> DataFrame:
    """All options with rank (from 1) and softmax probability in their group. Groups are the options of one question, so a window holds few rows."""
    from pyspark.sql import Window

    every, ordered = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.desc(score), order)
    e = F.exp((F.col(score) - F.max(score).over(every)) / temperature)
    return options.withColumn("rank", F.row_number().over(ordered)).withColumn("__e", e).withColumn("probability", F.col("__e") / F.sum("__e").over(every)).drop("__e")


def judge(probabilities: DataFrame, columns: tuple[str, str, str] = ("p0", "p1", "p2")) -> DataFrame:
    """Rows of three class probabilities with the verdict's name and confidence; the first of equal ones."""
    p0, p1, p2 = map(F.col, columns)
    name = F.when((p0 >= p1) & (p0 >= p2), "contradiction").when(p1 >= p2, "entailment").otherwise("neutral")
    return probabilities.withColumn("verdict", name).withColumn("confidence", F.greatest(p0, p1, p2))


def rate(options: DataFrame, group: str, level: str, probability: str) -> DataFrame:
    """The expected level of each group; groups without mass are left out."""
    return options.groupBy(group).agg((F.sum(F.col(level) * F.col(probability)) / F.nullif(F.sum(probability), F.lit(0.0))).alias("rating")).where("rating IS NOT NULL")


def debias(scores: DataFrame, group: str, shift: str, position: str, options: str, score: str, most: int = 20) -> DataFrame:
    """The mean score of each option over the cyclic shifts in which its question was asked: what stands at a position in a shift is option (position + shift) mod options.

    A question of one option scores 1; one of more than ``most`` is an error.
    """
    many = scores.where(F.col(options) > most).select(group).limit(1).collect()
    if many:
        raise ValueError(f"{group} {many[0][0]} has more than {most} options")
    slot = F.pmod(F.col(position) + F.col(shift), F.col(options))
    return scores.groupBy(group, slot.alias("slot")).agg(F.avg(F.when(F.col(options) == 1, 1.0).otherwise(F.col(score))).alias("score"))
