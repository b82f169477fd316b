"""Line dedup: repeated runs of lines, found by prefix doubling over line ranks.

Every line gets a rank (its place among the sorted distinct lines that occur
more than once). Doubling joins the rank of a position with the rank h lines
further on and ranks the pairs again, so after k steps equal ranks mean equal
runs of 2^k lines: the intervals of the suffix array whose longest common
prefix is at least that long. Positions whose run is unique leave after every
step. Steps go up to ``min_run`` lines (the last step overlaps where it is no
power of two); longer repeated runs are unions of overlapping intervals of
that length, so their neighbours merge into maximal runs. A single line of more
than ``passage_words`` words is a run by itself: a passage, wherever it stands.
In each interval the first position in corpus order stays and the lines of all
later ones go.

Corpus order is (doc_id, hash of the text, line). Counts are combined before
they are shuffled and sorting is by range over distinct keys, so a line that
fills the corpus is one key there; where ranks are joined back to positions its
rows meet in one key, which Spark's adaptive skew join splits.

Defined results: a null text stays null and has no lines; a null doc_id comes
first; rows equal in doc_id and text are one document and share its fate; an
empty table gives an empty result; other columns pass through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Stands for a null doc_id; smaller than every other.
NULL_ID = -(1 << 63)
AT = ["d", "h", "i"]
#: In production, a line of more words is a passage.
PASSAGE_WORDS = 50


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_gf_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_gf_h", F.xxhash64("text"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (d, h, i, keys) whose keys occur at two positions or more, with rank and the first of these positions."""
    groups = rows.groupBy(*keys).agg(F.min(F.struct(*AT)).alias("first"), F.max(F.struct(*AT)).alias("last")).where("first <> last").drop("last")
    groups = cut(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()))
    return rows.join(groups, keys).select(*AT, "rank", "first", *(c for c in rows.columns if c == "passage"))


def passage(line: Column, passage_words: int | None) -> Column:
    """Whether a line has more words than that; so many words need twice as many bytes."""
    if passage_words is None:
        return F.lit(False)
    return F.when(F.octet_length(line) > 2 * passage_words, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) > passage_words).otherwise(False)


def repeated_runs(docs: DataFrame, min_run: int = 2, passage_words: int | None = None) -> DataFrame:
    """Positions (d, h, i) at which a run of n lines starts that also starts earlier: of min_run lines, or one that is a passage."""
    text = _keys(docs.select("doc_id", "text"))
    rows = text.select(F.col("_gf_d").alias("d"), F.col("_gf_h").alias("h"), F.posexplode(lines(F.col("text"))).alias("i", "line"))
    found = ranked(rows.select(*AT, F.unhex(F.md5("line")).alias("a"), passage(F.col("line"), passage_words).alias("passage")), ["a"])
    found = found.groupBy(*AT).agg(F.min("rank").alias("rank"), F.min("first").alias("first"), F.max("passage").alias("passage"))  # rows equal in doc_id and text are one
    later = F.struct(*AT) != F.col("first")
    size, alone = 1, None
    while size < min_run:
        step = min(size, min_run - size)
        found = cut(found)
        if size == 1 and passage_words is not None:
            alone = found.where(F.col("passage") & later).select(*AT, F.lit(1).alias("n"))
        found = found.drop("passage")
        ahead = found.select("d", "h", (F.col("i") - step).alias("i"), F.col("rank").alias("b"))
        found = ranked(found.withColumnRenamed("rank", "a").join(ahead, AT).select(*AT, "a", "b"), ["a", "b"])
        size += step
    runs = found.where(later).select(*AT, F.lit(min_run).alias("n"))
    return runs if alone is None else runs.unionByName(alone)


def with_deleted(docs: DataFrame, min_run: int = 2, passage_words: int | None = None) -> DataFrame:
    """docs with _gf_deleted: the sorted indices of the lines that go."""
    starts = repeated_runs(docs, min_run, passage_words)
    gone = starts.groupBy("d", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("i", F.col("i") + F.col("n") - 1))))).alias("_gf_deleted"))
    gone = gone.withColumnsRenamed({"d": "_gf_gd", "h": "_gf_gh"})
    keyed = _keys(docs)
    out = keyed.join(gone, (F.col("_gf_d") == F.col("_gf_gd")) & (F.col("_gf_h") == F.col("_gf_gh")), "left")
    return out.select(*docs.columns, F.coalesce("_gf_deleted", F.array().cast("array<int>")).alias("_gf_deleted"))


def kept_text() -> Column:
    """The text without the lines in _gf_deleted; only rows that lose lines are taken apart."""
    all_lines = lines(F.col("text"))
    rest = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_gf_deleted"))
    return F.when(F.size("_gf_deleted") == 0, F.col("text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get(all_lines, i)), "\n"))


def clean(docs: DataFrame, min_run: int = 2, passage_words: int | None = None) -> DataFrame:
    """docs with later copies of repeated line runs deleted from text; all rows and columns stay."""
    return with_deleted(docs, min_run, passage_words).withColumn("text", kept_text()).select(*docs.columns)


def report(docs: DataFrame, min_run: int = 2, passage_words: int | None = None) -> DataFrame:
    """A row for each row of docs: lines, deleted lines, maximal deleted runs, the longest of them, digest of what is kept."""
    gone = F.col("_gf_deleted")
    out = with_deleted(docs.select("doc_id", "text"), min_run, passage_words)
    runs = F.aggregate(
        gone,
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("runs"), F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"] + 1, s["runs"]).otherwise(s["runs"] + 1).alias("runs"), F.when(x == s["last"] + 1, s["now"] + 1).otherwise(1).alias("now"), F.greatest(s["most"], F.when(x == s["last"] + 1, s["now"] + 1).otherwise(1)).alias("most")),
    )
    return out.select(
        "doc_id", F.coalesce(F.size(lines(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_deleted"), runs.alias("r"), F.sha2(F.coalesce(kept_text(), F.lit("")), 256).alias("kept_sha256")
    ).select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), "n_deleted", F.col("r.runs").cast("long").alias("n_runs"), F.col("r.most").cast("long").alias("longest_run"), "kept_sha256")
