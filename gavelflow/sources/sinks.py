"""Writers. Each commits atomically through Spark's output protocol; rerunning a write replaces it."""

from __future__ import annotations

import contextlib
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def columnar(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def manifest(df: DataFrame, path: str, label: str = "label", source: str = "source") -> None:
    """One JSON document beside the data: rows, and rows by label and by source."""
    by = lambda c: df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(c))
    df.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(F.broadcast(by(label))).crossJoin(F.broadcast(by(source))).coalesce(1).write.mode("overwrite").json(path)  # one row each


def sqlite(df: DataFrame, path: str, table: str, most: int = 100_000) -> None:
    """df as a table of an SQLite file, on whatever file system path is; an error for more than ``most`` rows, as the file is made on the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    with contextlib.closing(sqlite3.connect(":memory:")) as db:
        db.execute(f"CREATE TABLE {table} ({', '.join(df.columns)})")
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in rows])
        db.commit()
        content = db.serialize()
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report of at most ``most`` rows as a table."""
    head, rows = df.columns, df.limit(most).collect()
    line = lambda cells: f"| {' | '.join(str(c) for c in cells)} |"
    return "\n".join([line(head), line(["---"] * len(head)), *(line(r) for r in rows)])
