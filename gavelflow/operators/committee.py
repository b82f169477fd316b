"""Votes of several judges on samples: tally, and the policy that settles a label, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(votes: DataFrame, sample: str = "sample", label: str = "label", status: str = "status", generator: str = "gen") -> DataFrame:
    """sample, gen, judges, n_ok and c0, c1, c2 (ok votes by label) of newest votes."""
    ok = F.col(status) == "ok"
    return votes.groupBy(F.col(sample).alias("sample")).agg(F.min(generator).alias("gen"), F.count(F.lit(1)).alias("judges"), F.count_if(ok).alias("n_ok"), *(F.count_if(ok & (F.col(label) == k)).alias(f"c{k}") for k in range(3)))


def resolve(t: DataFrame) -> DataFrame:
    """A tally with final, kind, severity and confidence.

    The generator's label stays without an ok vote, on a tie, without a majority, and where a single vote speaks
    against it; else the most voted label is final. A unanimous change counts as a control where the generator
    said that the claim follows, or that it is contradicted and all find it open.
    """
    c = [F.col(f"c{k}") for k in range(3)]
    gen, n_ok, judges = F.col("gen"), F.col("n_ok"), F.col("judges")
    most = F.greatest(*c)
    top = F.when((c[0] >= c[1]) & (c[0] >= c[2]), 0).when(c[1] >= c[2], 1).otherwise(2)
    tie = sum((F.when(x == most, 1).otherwise(0) for x in c[1:]), F.when(c[0] == most, 1).otherwise(0)) > 1
    split, alone, turned, absent = tie | (most * 2 <= n_ok), (top != gen) & (most < 2), (most == n_ok) & (top != gen), judges > n_ok
    keeps = (n_ok == 0) | split | alone
    control = ((gen == 1) & (top != 1)) | ((gen == 0) & (top == 2))
    kind = F.when(n_ok == 0, "no_judge_verdicts").when(split, "committee_split_tie").when(alone, "insufficient_quorum").when(turned, "unanimous_label_override").when(most < n_ok, "committee_split").when(absent, "partial_committee_failure").otherwise("unanimous_consensus")
    level = lambda whole, short: F.when(absent, short).otherwise(whole)
    severity = F.when(keeps, "high").when(turned, F.when(control, level("low", "medium")).otherwise(level("medium", "high"))).when(most < n_ok, "high").otherwise(level("none", "medium"))
    share = lambda n, of: n / F.nullif(of, F.lit(0)).cast("double")
    confidence: Column = F.when(n_ok == 0, 0.0).when(~keeps & turned, F.round(share(n_ok, judges), 3)).otherwise(share(most, n_ok))
    return t.withColumn("final", F.when(keeps, gen).otherwise(top)).withColumn("kind", kind).withColumn("severity", severity).withColumn("confidence", confidence).withColumn("needs_review", F.col("kind") != "unanimous_consensus")
