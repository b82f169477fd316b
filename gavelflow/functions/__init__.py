"""Column functions that Spark lacks, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rational approximation 7.1.26 of Abramowitz and Stegun is too coarse; this is the continued fraction's depth.
DEPTH = 60


def erfc(x: Column) -> Column:
    """Complementary error function: a Taylor sum below 2, a continued fraction from there; within 1e-12 for x >= 0."""
    term = F.struct(x.alias("t"), x.alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), term, lambda a, n: F.struct((-a["t"] * x * x / n).alias("t"), (a["s"] - a["t"] * x * x / n / (n * 2 + 1)).alias("s")), lambda a: a["s"])
    tail = F.aggregate(F.sequence(F.lit(DEPTH), F.lit(1)), F.lit(0.0), lambda a, k: k / F.lit(2.0) / (x + a))
    root_pi = F.sqrt(F.lit(3.141592653589793))
    return F.when(x < 2, 1 - 2 / root_pi * series).otherwise(F.exp(-x * x) / root_pi / (x + tail))


def option_code(i: Column) -> Column:
    """0 -> A .. 25 -> Z, 26 -> AA .. up to 701 -> ZZ."""
    letter = lambda c: F.chr(c + 65)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))
