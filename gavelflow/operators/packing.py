"""Token-budget packing of rows with atomic groups, and temperature fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_pack(df: DataFrame, group: str, order: str, length: str, budget: int, shard: str | None = None) -> DataFrame:
    """Batches of whole groups: units by (-longest row, first row); a batch is closed when longest * rows would pass the budget.

    The greedy pass is sequential, so it runs per shard over units, not rows; a unit over the budget gets a batch of its own.
    """
    # null, -1 and the empty text say that a row is in no group
    kind = dict(df.dtypes)[group]
    alone = F.col(group).isNull() | F.col(group).cast("string").isin("-1", "")
    df = df.withColumn("__unit", F.when(alone, F.concat(F.lit("row:"), F.col(order).cast("string"))).otherwise(F.concat(F.lit("group:"), F.col(group).cast("string"))))
    units = df.groupBy("__unit").agg(F.first(group).alias(group), F.max(length).alias("longest"), F.count(F.lit(1)).alias("size"), F.min(order).alias("first"), (F.first(shard) if shard else F.lit(0)).alias("shard"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["longest", "first"], ascending=[False, True])
        batch, rows, most, out = 0, 0, 0, []
        for longest, size in zip(t["longest"], t["size"]):
            if rows and max(most, longest) * (rows + size) > budget:
                batch, rows, most = batch + 1, 0, 0
            rows, most = rows + size, max(most, longest)
            out.append(batch)
        return t.assign(batch=out)[[group, "first", "shard", "batch"]]

    return units.groupBy("shard").applyInPandas(run, f"{group} {kind}, first {dict(df.dtypes)[order]}, shard int, batch long")


def temperature_fit(logits: DataFrame, lo: float = 0.05, hi: float = 10.0, points: int = 33, rounds: int = 3) -> DataFrame:
    """The temperature of least mean negative log-likelihood, by a grid that narrows; logits: z0, z1, z2, gold."""
    spark = logits.sparkSession
    for _ in range(rounds):
        grid = spark.createDataFrame([(lo * (hi / lo) ** (i / (points - 1)),) for i in range(points)], "t double")
        z = [F.col(f"z{i}") / F.col("t") for i in range(3)]
        nll = F.log(sum((F.exp(x) for x in z[1:]), F.exp(z[0]))) - F.when(F.col("gold") == 0, z[0]).when(F.col("gold") == 1, z[1]).otherwise(z[2])
        fit = logits.crossJoin(F.broadcast(grid)).groupBy("t").agg(F.avg(nll).alias("nll"))  # a fixed grid of few rows
        best = fit.agg(F.min_by("t", "nll")).first()[0]
        step = (hi / lo) ** (1 / (points - 1))
        lo, hi = best / step, best * step
    return fit.where(F.col("t") == best).select(F.round("t", 4).alias("t"), F.round("nll", 6).alias("nll"))
