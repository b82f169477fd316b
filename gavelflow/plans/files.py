"""Queries over readers and sinks. Files are made from the driver's tables in the shared folder, then read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from gavelflow.sources import readers as R
from gavelflow.sources import sinks as S

from .base import query

PAIR = "id long, source string, label int"
SQL = "SELECT d.doc_id AS id, d.source, coalesce(l.quality, 2) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def folder(spark) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:  # a folder of this machine will do only where all runs on it
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/gavelflow-files-{uuid.uuid4().hex}"


def _pairs(spark, sf):
    d, y = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return d.join(y, "doc_id", "left").select(F.col("doc_id").alias("id"), "source", F.coalesce("quality", F.lit(2)).alias("label"))


def round_trip(write, read):
    def run(spark, sf):
        path = folder(spark)
        write(_pairs(spark, sf), path)
        return read(spark, path)

    return run


query("scan_jsonl", round_trip(S.jsonl, lambda s, p: R.jsonl(s, p, PAIR)), SQL)
query("scan_json", round_trip(lambda df, p: df.groupBy(F.floor(F.col("id") / 1000).alias("k")).agg(F.collect_list(F.struct("id", "source", "label")).alias("data")).select("data").write.option("maxRecordsPerFile", 1).json(p), lambda s, p: R.json_document(s, p, PAIR)), SQL)
query("scan_csv_tsv", round_trip(lambda df, p: df.write.option("header", True).option("sep", "\t").csv(p), lambda s, p: R.delimited(s, p, "id string, source string, label string", "\t")), SQL.replace("d.doc_id AS id", "CAST(d.doc_id AS varchar) AS id").replace("coalesce(l.quality, 2)", "CAST(coalesce(l.quality, 2) AS varchar)"))
query("scan_parquet", round_trip(S.columnar, lambda s, p: s.read.schema(PAIR).parquet(p)), SQL)
query("scan_gzip_jsonl", round_trip(lambda df, p: S.jsonl(df, p, gzip=True), lambda s, p: R.jsonl(s, p, PAIR).where("label = 1")), f"SELECT * FROM ({SQL}) WHERE label = 1")
query("scan_limit", round_trip(S.columnar, lambda s, p: s.read.schema(PAIR).parquet(p).orderBy("id").limit(25)), f"SELECT * FROM ({SQL}) ORDER BY id LIMIT 25")
query("scan_resilient", round_trip(lambda df, p: df.select(F.when(F.col("id") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("id", "source", "label")))).write.text(p), lambda s, p: R.jsonl(s, p, PAIR)), f"SELECT * FROM ({SQL}) WHERE id % 9 <> 0")
query("scan_optional", lambda spark, sf: R.optional(spark, f"{sf}/no_such_table.parquet", PAIR), f"SELECT * FROM ({SQL}) WHERE false")
query("scan_required", lambda spark, sf: R.required(spark, f"{sf}/region.parquet", "r_regionkey int, r_name string"), "SELECT r_regionkey, r_name FROM region")
query(
    "scan_columnar_hub", lambda spark, sf: R.hub(spark, f"{sf}/customer.parquet", "c_custkey", "validation").select("c_custkey", "c_name", "place"),
    "SELECT c_custkey, c_name, md5(concat('42:', c_custkey)) AS place FROM customer WHERE CAST(concat('0x', substr(md5(concat('split:', c_custkey)), 1, 7)) AS bigint) % 10 = 0",
)
query("scan_parts", round_trip(lambda df, p: df.write.partitionBy("label").json(p), lambda s, p: s.read.schema(PAIR).json(p).orderBy("label", "id")), SQL)


def _database(spark, sf):
    """The nations as a table of a database file, read back by a statement that joins and filters there."""
    path = f"{folder(spark)}.db"
    S.sqlite(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), path, "nation")
    return R.sqlite(spark, path, "SELECT a.n_nationkey, a.n_name, count(*) AS neighbours FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1, 2", "n_nationkey long, n_name string, neighbours long")


query("scan_sql_table", _database, "SELECT n_nationkey, n_name, count(*) OVER (PARTITION BY n_regionkey) AS neighbours FROM nation")
query("file_sha", lambda spark, sf: R.file_hashes(spark, f"{sf}/region.parquet"))
query("sink_jsonl", round_trip(S.jsonl, lambda s, p: R.jsonl(s, p, PAIR).groupBy("label").agg(F.count(F.lit(1)).alias("n"))), f"SELECT label, count(*) AS n FROM ({SQL}) GROUP BY label")
query("sink_gzip", round_trip(lambda df, p: S.jsonl(df, p, gzip=True), lambda s, p: R.jsonl(s, p, PAIR).groupBy("source").agg(F.count(F.lit(1)).alias("n"))), f"SELECT source, count(*) AS n FROM ({SQL}) GROUP BY source")
query("sink_columnar", round_trip(lambda df, p: S.columnar(df, p, ["source"]), lambda s, p: s.read.schema(PAIR).parquet(p)), SQL)
query("sink_manifest", round_trip(S.manifest, lambda s, p: s.read.schema("n_rows long").json(p)), "SELECT count(*) AS n_rows FROM documents")
query("sink_markdown", lambda spark, sf: spark.createDataFrame([(S.markdown(spark.read.parquet(f"{sf}/region.parquet").orderBy("r_regionkey")),)], "report string"), "SELECT concat('| r_regionkey | r_name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', r_regionkey, ' | ', r_name, ' |'), chr(10) ORDER BY r_regionkey)) AS report FROM region")
query("atomic_snapshot", round_trip(lambda df, p: [S.columnar(df.where("label = 0"), p), S.columnar(df, p)], lambda s, p: s.read.schema(PAIR).parquet(p)), SQL)
