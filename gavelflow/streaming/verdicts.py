"""Verdicts as a stream: idempotent upsert, early exit by sample, and a watchdog over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT = "seq long, sample long, judge string, label int, status string, latency double, ts timestamp"


def stream_of(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Events as verdicts; the pattern in the path lets one file be a source too."""
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    return as_verdicts(e)


def as_verdicts(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 500).alias("sample"), F.col("event_type").alias("judge"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("label"),
        F.when(F.col("event_type") == "error", "offline").otherwise("ok").alias("status"), F.col("value").alias("latency"), F.col("ts").cast("timestamp").alias("ts"),
    )


def run(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run what is available to the end; give back the files written."""
    spark, schema = stream.sparkSession, stream.schema
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def upsert(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """The newest verdict of each (sample, judge). Each batch is written under its number, so a batch that runs twice replaces itself."""
    spark = stream.sparkSession
    latest = lambda df: df.groupBy("sample", "judge").agg(F.max_by(F.struct(*stream.columns), "seq").alias("r")).select("r.*")
    stream.writeStream.foreachBatch(lambda df, n: latest(df).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.schema(stream.schema).parquet(f"{out}/batch=*"))


def settle(least: int = 2) -> Callable:
    """State of a sample: ok votes so far, their common label (-1: they differ), whether it settled."""

    def step(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        votes, label, settled = state.get if state.exists else (0, -2, False)
        rows = pd.concat(list(chunks)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            if settled:
                break
            if r.status == "ok":
                votes, label = votes + 1, int(r.label) if label in (-2, int(r.label)) else -1
            settled = votes >= least and label >= 0
            out.append((key[0], int(r.seq), r.judge, settled))
        state.update((votes, label, settled))
        yield pd.DataFrame(out, columns=["sample", "seq", "judge", "settled"])

    return step


def early_exit(stream: DataFrame, least: int = 2) -> DataFrame:
    """The votes that are still asked for: none of a sample after ``least`` ok votes agree and none differs."""
    return stream.select("seq", "sample", "judge", "label", "status").groupBy("sample").applyInPandasWithState(settle(least), "sample long, seq long, judge string, settled boolean", "votes int, label int, settled boolean", "append", "NoTimeout")


def watchdog(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failure rate by event-time window; windows close when the watermark passes them."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("failed")).select(F.col("w.start").alias("start"), "n", "failed")
