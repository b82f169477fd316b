"""Ranks and running sums over a whole table, in two levels.

A window without a partition sorts the whole table in one task. Here rows are
first dealt to buckets that follow the order, so that each bucket is ranked by
itself; what stands before a bucket comes from the bucket totals, a table of at
most ``buckets`` rows a group. For hash orders a bucket is the hash's first
digits; for values it is the interval between approximate quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, NUMBER, SUM = "__bucket", "__number", "__sum"


def draw(x: Column, n: int | Column) -> Column:
    """A number from 0 to n - 1, by a hash of x."""
    return F.pmod(F.conv(F.substring(F.md5(x.cast("string")), 1, 7), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n).cast("int")


def by_hash(h: str, digits: int = 3) -> Column:
    """The bucket of a hexadecimal hash."""
    return F.substring(h, 1, digits)


def by_value(df: DataFrame, column: str, buckets: int = 256, falling: bool = False) -> Column:
    """The bucket of a number: how many approximate quantiles lie under it. Rows of one value share a bucket."""
    edges = sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(column))) if edges else F.lit(0)
    return -place if falling else place


def ranked(df: DataFrame, bucket: Column, order: list[Column | str], by: list[str] | None = None, value: Column | None = None, rank: str = "rank", before: str | None = None, size: str | None = None, total: str | None = None) -> DataFrame:
    """df with rank (from 1) in the order within the groups ``by``; before: the sum of value of earlier rows; size and total: rows and sum of the group.

    bucket must not fall where the order rises. Groups must be few: their bucket totals are broadcast.
    """
    by = by or []
    value = F.lit(1) if value is None else value
    d = df.withColumn(BUCKET, bucket).withColumn(SUM, value)
    totals = d.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("n"), F.sum(SUM).alias("s"))
    running, group = Window.partitionBy(*by).orderBy(BUCKET), Window.partitionBy(*by)
    totals = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col(BUCKET).alias("__b"), (F.sum("n").over(running) - F.col("n")).alias("__rows_before"), (F.sum("s").over(running) - F.col("s")).alias("__sum_before"), F.sum("n").over(group).alias("__size"), F.sum("s").over(group).alias("__total"))
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order)
    d = d.withColumn(NUMBER, F.row_number().over(inside))
    if before:
        d = d.withColumn(before, F.sum(SUM).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(SUM))
    same = F.col(BUCKET).eqNullSafe(F.col("__b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    d = d.join(F.broadcast(totals), same)
    d = d.withColumn(rank, F.col(NUMBER) + F.col("__rows_before"))
    if before:
        d = d.withColumn(before, F.col(before) + F.col("__sum_before"))
    for name, source in ((size, "__size"), (total, "__total")):
        if name:
            d = d.withColumn(name, F.col(source))
    return d.drop(BUCKET, SUM, NUMBER, "__b", "__rows_before", "__sum_before", "__size", "__total", *(f"__{c}" for c in by))
