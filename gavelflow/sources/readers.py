"""Readers of record files: JSON lines, JSON, CSV and TSV, Parquet, gzip shards, parts; and their checks."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelflow.operators.ranks import draw

#: Names under which the columns of a pair are found, best first.
CANDIDATES = {"premise": ["premise", "context", "sentence1", "text"], "hypothesis": ["hypothesis", "claim", "sentence2", "question"], "label": ["label", "gold_label", "answer"]}


def jsonl(spark: SparkSession, path: str | list[str], schema: str, resilient: bool = True) -> DataFrame:
    """JSON lines, gzip or plain. Malformed lines: skipped, or an error."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if resilient else "FAILFAST").json(path)


def quarantined(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the malformed ones in column _corrupt_record instead of being lost."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds a list of records, or {"data": [records]}."""
    rows = spark.read.schema(f"{schema}, data array<struct<{schema.replace(' ', ':')}>>" if "," not in schema else f"{schema}, data array<struct<{', '.join(':'.join(c.strip().split(' ', 1)) for c in schema.split(','))}>>").option("multiLine", True).json(path)
    names = [c for c in rows.columns if c != "data"]
    nested = rows.where("data IS NOT NULL").select(F.explode("data").alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])
    return rows.where("data IS NULL").select(*names).unionByName(nested)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; every value stays text."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All parts of a folder, with the name of the part, which gives their order."""
    return spark.read.schema(schema).json(f"{folder}/*").withColumn("part", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet at path, or no rows of that schema where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def hub(spark: SparkSession, path: str, key: str, split: str = "train", seed: int = 42) -> DataFrame:
    """A split of a columnar dataset (a tenth by hash is validation), with ``place``: its rows sorted by it are shuffled."""
    held = draw(F.concat(F.lit("split:"), F.col(key).cast("string")), 10) == 0
    return spark.read.parquet(path).where(held if split == "validation" else ~held).withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def required(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).parquet(path)


def sqlite(spark: SparkSession, path: str, statement: str, schema: str) -> DataFrame:
    """The rows of a statement over each SQLite file at path (a file, a folder or a pattern): files come through Spark's reader, one task takes one file at a time."""
    names = spark.createDataFrame([], schema).columns

    def run(batches):
        import sqlite3

        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with contextlib.closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(bytes(content))
                    found = db.execute(statement)
                    while rows := found.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, first 16 hex digits of the SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.substring(F.sha2("content", 256), 1, 16).alias("sha16"))


def resolve_columns(df: DataFrame) -> DataFrame:
    """df with the columns of a pair under their own names; found case-insensitively by priority, else an error."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    found = {}
    for role, names in CANDIDATES.items():
        hit = next((lower[n] for n in names if n in lower and lower[n] not in found.values()), None)
        if hit is None:
            raise ValueError(f"no column for {role} among {df.columns}")
        found[role] = hit
    return df.select(*[F.col(c).alias(role) for role, c in found.items()], *[F.col(c) for c in df.columns if c not in found.values()])


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df cast to schema; columns it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
