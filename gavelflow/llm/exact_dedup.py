"""Exact deduplication as a stateful stream, DataFrame functions only.

The stream keeps one state row for each digest, on disk (RocksDB), and no
watermark ever expires it: how many rows had the digest, and of the best of
them the stable identifier and the content locator (its file, and its row
there). Micro-batches of bounded size go through it; with a checkpoint that
is kept, a later call takes in only the files that are new. Every row that hit
another is then compared in full with the keeper's text, which is found by its
locator: keepers are copied to as many parts as their groups need, so a text
that fills the corpus is compared in many tasks, and rows that hit no other
send no text at all. Rows whose bytes differ in spite of equal digests are
grouped again by the full text.

Defined results: a null text counts as empty; a null doc_id sorts after every
other; rows that repeat a doc_id and a text are kept or dropped together; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_files, release, shared_dir

#: The characters that do not count when texts are compared.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
STORE = "spark.sql.streaming.stateStore"
#: The disk-backed store, with logs of changes as checkpoints, and without space set aside for each of many small stores.
STORE_CONF = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STORE}.rocksdb.allowFAllocate": "false",
}


#: Rows of one group that are compared in one part.
PART_ROWS = 1000


def locator() -> Column:
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _best() -> Column:
    """Orders the rows of a group: most code points, then smallest doc_id, nulls last."""
    return F.struct(F.char_length(F.coalesce("text", F.lit(""))).alias("size"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.col("doc_id").cast("long")).alias("back"), F.col("locator"))


def _keep_id(best: Column) -> Column:
    return F.bitwise_not(best["back"])


def ingest(stream: DataFrame, checkpoint: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Run all available micro-batches of (doc_id, text, locator) through the keyed state at checkpoint."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE_CONF}
    for k, v in STORE_CONF.items():
        spark.conf.set(k, v)
    try:
        state = stream.select(digest(normalised(F.col("text"))).alias("digest"), _best().alias("best")).groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.max("best").alias("best"))
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state rows: digest, group_size, keep_id, locator of the keeper."""
    s = spark.read.format("statestore").option("path", checkpoint).load()
    count, best = s.schema["value"].dataType.names
    return s.select("key.digest", F.col("value")[count].alias("group_size"), _keep_id(F.col("value")[best]).alias("keep_id"), F.col("value")[best]["locator"].alias("locator"))


def alike(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of groups in which a row differs from the keeper, after comparing all their texts."""
    spark, norm = docs.sparkSession, normalised(F.col("text"))
    groups = cut(state.where("group_size > 1").select("digest", "locator", F.ceil(F.col("group_size") / PART_ROWS).cast("int").alias("parts")))
    # rows that hit no other are to be left out before the shuffle, by a Bloom filter at every size
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "0")
    try:
        keepers = docs.select("locator", norm.alias("kept")).join(groups.where("parts > 0"), "locator").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = docs.select(digest(norm).alias("digest"), "locator", norm.alias("norm")).join(groups.where("parts > 0").select("digest", "parts"), "digest").withColumn("part", F.pmod(F.xxhash64("locator"), F.col("parts")).cast("int"))
        return cut(rows.join(keepers.select("digest", "part", "kept"), ["digest", "part"]).where("norm <> kept").select("digest").distinct())
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def decide(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Of every row of docs (doc_id, text, locator) the group and the row that stays, after the full texts were compared."""
    norm = normalised(F.col("text"))
    unlike = alike(docs, state, digest)
    lite = docs.select("doc_id", F.sha2(norm, 256).alias("text_sha256"), *([] if digest is sha256 else [digest(norm).alias("digest")]))
    if digest is sha256:
        lite = lite.withColumn("digest", F.unhex("text_sha256"))
    out = lite.join(state.select("digest", "group_size", "keep_id"), "digest", "left")
    if unlike.limit(1).count():  # digests that different texts share: their rows are grouped by the text itself
        again = docs.withColumn("digest", digest(norm)).join(unlike, "digest", "left_semi")
        again = again.groupBy("digest", norm.alias("norm")).agg(F.count(F.lit(1)).alias("group_size"), _keep_id(F.max(_best())).alias("keep_id")).select("digest", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id")
        out = out.join(unlike, "digest", "left_anti").unionByName(lite.join(again, ["digest", "text_sha256"]))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(spark: SparkSession, path: str, files_per_batch: int = 1000, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None) -> DataFrame:
    """Deduplicate the Parquet table at path; files_per_batch bounds a micro-batch.

    checkpoint: a folder that all executors share, kept: another call with it takes in only files that have come since.
    """
    docs = spark.read.parquet(path)
    own = checkpoint or shared_dir(spark)
    columns = (F.col("doc_id").cast("long").alias("doc_id"), "text", locator().alias("locator"))
    if docs.inputFiles():
        at = path if checkpoint else f"{path[:-1]}[{path[-1]}]"  # a pattern: a plain path to a single file is refused here
        ingest(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_batch).parquet(at).select(*columns), own, digest)
    state = cut(state_of(spark, own))
    if not checkpoint:
        drop_files(spark, own)
    release(spark)
    return decide(docs.select(*columns), state, digest)
