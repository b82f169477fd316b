"""Temperature mixing of sources to target weights, realised as block permutations.

Source token shares are raised to an exponent between 0 (all sources alike)
and 1 (as they are) and normalised. The exponent is found by bisection, 32
points at a time, evaluated by Spark over the table of sources: the largest
that still reaches the target entropy, or a larger one if otherwise some
source would be repeated more often than the limit allows. The weights then
get a token budget. A source's part of it is a number of whole passes and a
part of one more; each pass is a permutation of the source's documents by a
seeded hash, cut into blocks of about ``block_tokens`` tokens. The last pass
stops with the document that reaches the source's part. The blocks of all
sources are laid out over one mixture, each source's evenly, so that any stretch
of it holds the sources nearly by their weights: a block's ``turn``.

Running token sums are made in two levels: a source's pass is cut into many
buckets by hash, so the rows of a source that holds a third of all are summed
in parallel, and only bucket totals are added up in order.

With no budget given, the smallest one is taken at which no document is left
out: the source that is repeated least gets exactly one pass.

Defined results: null or empty texts have no tokens and come once a pass; a
null source is a source of its own; sources without tokens get one pass;
repeated rows each take part; an empty table gives an empty result; all
columns of the input are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

POINTS = 32


def tokens(text: Column) -> Column:
    """Words of a text, the token count used for shares."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def counted(docs: DataFrame, source: str = "source") -> DataFrame:
    """Of every row its id, source, hash of the text and tokens: the texts are read once, here."""
    return cut(docs.select(F.col("doc_id").alias("_gf_id"), F.col(source).alias("_gf_src"), F.xxhash64("text").alias("_gf_h"), tokens(F.col("text")).alias("_gf_tokens")))


def source_table(rows: DataFrame) -> DataFrame:
    """src, tokens, rows of each source, from counted rows."""
    return cut(rows.groupBy(F.col("_gf_src").alias("src")).agg(F.sum("_gf_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))


def exponent(sources: DataFrame, entropy: float, repeats: float, rounds: int = 7) -> float:
    """The largest exponent in [0, 1] whose weights reach ``entropy`` (part of the highest possible one),
    raised if need be until no source is repeated over ``repeats`` times as often as the least repeated one."""
    has = sources.where("tokens > 0")
    total = has.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total[1] or total[1] == 1:
        return 1.0
    share, spark = F.col("tokens") / F.lit(float(total[0])), has.sparkSession
    even = F.log("z") - F.col("wl") / F.col("z") >= F.lit(entropy * math.log(total[1]))
    rare = F.col("most") / F.col("least") <= F.lit(repeats * (1 + 1e-12))
    points = lambda lo, hi: [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
    falls, rises = (0.0, 1.0), (0.0, 1.0)  # where entropy falls under its target; where repetition comes within its limit
    for _ in range(rounds):  # both are searched at once: 66 points a round
        grids = points(*falls), points(*rises)
        table = spark.createDataFrame([(p,) for p in sorted({*grids[0], *grids[1]})], "a double")
        t = has.select(share.alias("s")).crossJoin(F.broadcast(table)).withColumn("w", F.pow("s", "a")).groupBy("a")
        t = t.agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("s")).alias("most"), F.min(F.col("w") / F.col("s")).alias("least"))
        ok = {r["a"]: (r["even"], r["rare"]) for r in t.select("a", even.alias("even"), rare.alias("rare")).collect()}
        last = max((i for i, p in enumerate(grids[0]) if ok[p][0]), default=None)
        first = min((i for i, p in enumerate(grids[1]) if ok[p][1]), default=None)
        falls = (0.0, 0.0) if last is None else (grids[0][last], grids[0][min(POINTS, last + 1)])
        rises = (1.0, 1.0) if first is None else (grids[1][max(0, first - 1)], grids[1][first])
    return max(falls[0], rises[1])


def plan(sources: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """src, tokens, rows, weight, target (tokens to draw)."""
    has = F.col("tokens") > 0
    total = float(sources.agg(F.sum("tokens")).first()[0] or 1)
    raw = F.when(has, F.pow(F.col("tokens") / total, F.lit(alpha))).otherwise(F.lit(0.0))
    z, least = (sources.agg(F.sum(raw).alias("z"), F.min(F.when(has, raw / F.col("tokens"))).alias("least")).first()) or (None, None)
    budget = float(budget) if budget is not None else (z / least if z and least else 0.0)
    return sources.withColumn("weight", raw / F.lit(float(z or 1))).withColumn("target", F.col("weight") * F.lit(budget))


def few(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of sources, to be broadcast if it has at most ``most`` rows (checked), else joined by shuffling."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def place(epoch: Column | str, seed: int) -> Column:
    """Where a row stands in a pass: a signed 64-bit hash; rows equal in doc_id and text stand together."""
    return F.xxhash64(F.lit(seed), epoch, "_gf_id", "_gf_h")


def n_passes() -> Column:
    """Passes that touch a source: the whole ones, and one more if tokens are left for it; rounding leaves none."""
    return F.when(F.col("tokens") > 0, F.greatest(F.ceil(F.col("target") / F.col("tokens") - 1e-9), F.lit(0))).otherwise(1).cast("int")


def passes(rows: DataFrame, sources: DataFrame, seed: int = 42, bucket_rows: int = 500, most_buckets: int = 65_536) -> DataFrame:
    """A row for each draw from counted rows: _gf_id, _gf_src, _gf_epoch, _gf_u, _gf_tokens, _gf_before (tokens before it in its pass), _gf_all (of the source), _gf_target."""
    buckets = F.greatest(F.lit(1), F.least(F.lit(most_buckets), F.ceil(F.col("rows") / bucket_rows)))
    s = sources.select("src", F.col("tokens").alias("_gf_all"), F.col("target").alias("_gf_target"), n_passes().alias("_gf_n"), buckets.alias("_gf_buckets"))
    d = rows.join(few(s), F.col("_gf_src").eqNullSafe(F.col("src"))).drop("src").where("_gf_n > 0")
    d = d.withColumn("_gf_epoch", F.explode(F.sequence(F.lit(0), F.col("_gf_n") - 1))).withColumn("_gf_u", place("_gf_epoch", seed))
    d = d.withColumn("_gf_bucket", F.floor((F.col("_gf_u").cast("double") / 2.0**64 + 0.5) * F.col("_gf_buckets")))
    # a null source gets a key of its own, so plain equality holds in what follows
    d = d.withColumn("_gf_s", F.struct(F.col("_gf_src").isNull().alias("none"), F.coalesce(F.col("_gf_src").cast("string"), F.lit("")).alias("name")))
    key = ["_gf_s", "_gf_epoch", "_gf_bucket"]
    totals = d.groupBy(*key).agg(F.sum("_gf_tokens").alias("_gf_sum"))
    totals = totals.withColumn("_gf_base", F.sum("_gf_sum").over(Window.partitionBy("_gf_s", "_gf_epoch").orderBy("_gf_bucket")) - F.col("_gf_sum")).drop("_gf_sum")
    inside = Window.partitionBy(*key).orderBy("_gf_u", "_gf_id", "_gf_tokens").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_gf_before", F.sum("_gf_tokens").over(inside) - F.col("_gf_tokens")).join(totals, key)
    d = d.withColumn("_gf_before", F.col("_gf_before") + F.col("_gf_base"))
    left = F.col("_gf_target") - F.col("_gf_epoch") * F.col("_gf_all")
    kept = d.where((F.col("_gf_all") == 0) | (left > F.col("_gf_all") - 0.5) | (F.col("_gf_before") < left))
    return kept.select("_gf_id", "_gf_src", "_gf_epoch", "_gf_u", "_gf_tokens", "_gf_before", "_gf_all", "_gf_target")


def turn(block: Column, block_tokens: int, seed: int) -> Column:
    """Where a block stands in the mixture, from 0 to 1: the blocks of each source lie evenly over all of it, each shifted by a hash within its stride.

    Any stretch of the mixture therefore holds the sources nearly by their weights.
    """
    blocks = F.greatest(F.lit(1.0), F.greatest(F.col("_gf_target"), F.col("_gf_all").cast("double")) / block_tokens)
    jitter = F.pmod(F.xxhash64(F.lit(seed), F.col("_gf_src").cast("string"), "_gf_epoch", block), F.lit(1 << 20)) / (1 << 20)
    at = (F.col("_gf_epoch") * F.col("_gf_all") + block * block_tokens) / block_tokens
    return F.least(F.lit(1.0), (at + jitter) / blocks)


def mix(docs: DataFrame, entropy: float = 0.95, repeats: float = 2.0, budget: int | None = None, seed: int = 42, block_tokens: int = 1_000_000, source: str = "source") -> DataFrame:
    """A row for each draw: doc_id, source, epoch, block, turn (place of the block in the mixture), before (tokens before it in its pass), tokens, weight of its source."""
    rows = counted(docs, source)
    s = source_table(rows)
    s = plan(s, exponent(s, entropy, repeats), budget)
    d = passes(rows, s, seed).join(few(s.select("src", F.round("weight", 9).alias("weight"))), F.col("_gf_src").eqNullSafe(F.col("src")))
    block = F.floor(F.col("_gf_before") / block_tokens).cast("long")
    return d.select(F.col("_gf_id").alias("doc_id"), F.col("_gf_src").alias("source"), F.col("_gf_epoch").alias("epoch"), block.alias("block"), F.round(turn(block, block_tokens, seed), 9).alias("turn"), F.col("_gf_before").alias("before"), F.col("_gf_tokens").alias("tokens"), "weight")


def mixed(docs: DataFrame, entropy: float = 0.95, repeats: float = 2.0, budget: int | None = None, seed: int = 42, source: str = "source") -> DataFrame:
    """The drawn rows with the columns of docs. Of a pass only the hash at which it ends is needed, so texts stay where they are."""
    rows = counted(docs, source)
    s = source_table(rows)
    s = plan(s, exponent(s, entropy, repeats), budget)
    ends = cut(passes(rows, s, seed).groupBy("_gf_src").agg(F.max(F.struct("_gf_epoch", "_gf_u")).alias("_gf_end")))
    drop_cut(rows)
    d = docs.withColumn("_gf_id", F.col("doc_id")).withColumn("_gf_h", F.xxhash64("text"))
    d = d.join(few(ends), F.col(source).eqNullSafe(F.col("_gf_src")))
    d = d.withColumn("_gf_epoch", F.explode(F.sequence(F.lit(0), F.col("_gf_end._gf_epoch"))))
    return d.where((F.col("_gf_epoch") < F.col("_gf_end._gf_epoch")) | (place("_gf_epoch", seed) <= F.col("_gf_end._gf_u"))).select(*docs.columns)
