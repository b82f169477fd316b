"""Queries over packing, fitting and the test of paired errors, which need more than SQL."""

from pyspark.sql import functions as F

from gavelflow.functions import erfc
from gavelflow.operators.packing import group_pack, temperature_fit

from .base import DUCK, SPARK, expand, query, tables
from .stats import PAIRED


def _sql(spark, sf, body):
    text = expand(body, SPARK)
    tables(spark, sf, text)
    return spark.sql(text)


def _mcnemar(spark, sf):
    t = _sql(spark, sf, PAIRED).select("slice", "b", "c").withColumn("n", F.col("b") + F.col("c"))
    chi = F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), 2) / F.col("n")
    low = F.least("b", "c")
    # binomial terms by a running product, exact for the few pairs under 25
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(low, F.lit(1)).cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, i: F.struct((a["term"] * (F.col("n") - i + 1) / i).alias("term"), F.when(i <= low, a["sum"] + a["term"] * (F.col("n") - i + 1) / i).otherwise(a["sum"]).alias("sum")), lambda a: a["sum"])
    p = F.when(F.col("n") == 0, 1.0).when(F.col("n") < 25, F.least(F.lit(1.0), 2 * exact / F.pow(F.lit(2.0), F.col("n")))).otherwise(erfc(F.sqrt(chi / 2)))
    return t.select("slice", "b", "c", F.round(p, 6).alias("p"))


# the oracle walks the units of each shard one by one
GREEDY = expand("""WITH RECURSIVE g AS (SELECT group_id, max(CAST(qty AS int)) AS longest, count(*) AS size, min(ord) AS first, CAST(group_id % 16 AS int) AS shard FROM grouped GROUP BY group_id),
    u AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY longest DESC, first) AS k FROM g),
    walk AS (SELECT group_id, first, shard, k, CAST(0 AS bigint) AS batch, size AS rows_, longest AS most FROM u WHERE k = 1
        UNION ALL SELECT u.group_id, u.first, u.shard, u.k, CASE WHEN greatest(w.most, u.longest) * (w.rows_ + u.size) > 2048 THEN w.batch + 1 ELSE w.batch END, CASE WHEN greatest(w.most, u.longest) * (w.rows_ + u.size) > 2048 THEN u.size ELSE w.rows_ + u.size END,
            CASE WHEN greatest(w.most, u.longest) * (w.rows_ + u.size) > 2048 THEN u.longest ELSE greatest(w.most, u.longest) END FROM walk w JOIN u ON u.shard = w.shard AND u.k = w.k + 1)
    SELECT group_id, first, shard, batch FROM walk""".replace("WITH RECURSIVE", "WITH"), DUCK).replace("WITH ", "WITH RECURSIVE ", 1)
query("group_pack", lambda spark, sf: group_pack(_sql(spark, sf, "SELECT group_id, ord, CAST(qty AS int) AS n, CAST(group_id % 16 AS int) AS shard FROM grouped"), "group_id", "ord", "n", 2048, "shard"), GREEDY)
query("temperature_fit", lambda spark, sf: temperature_fit(_sql(spark, sf, "SELECT gold, z0, z1, z2 FROM logit")))
# the oracle's error function is a series of positive terms
EXACT = "least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))))"
TAIL = "CASE WHEN x > 5 THEN 0 WHEN x = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 150), lambda n: exp(n * ln(4) + lgamma(n + 1) + (2 * n + 1) * ln(x) - lgamma(2 * n + 2)))) END"
query("mcnemar_mixed", _mcnemar, f"SELECT slice, b, c, round(CASE WHEN b + c = 0 THEN 1 WHEN b + c < 25 THEN {EXACT} ELSE {TAIL} END, 6) AS p FROM (SELECT slice, b, c, sqrt(pow(greatest(abs(b - c) - 1, 0), 2) / greatest(b + c, 1) / 2) AS x FROM ({expand(PAIRED, DUCK)}) AS q) AS t")
