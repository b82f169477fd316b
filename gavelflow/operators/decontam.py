"""Contamination checks: word n-grams against a reference set, and shingle overlap.

N-grams are compared as hashes first, so the shuffle moves eight bytes an
n-gram; only rows that share a hash are taken apart again and compared as text,
so no hash decides alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ws_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"(?U)\s+"), "")


def word_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w+)\b"), F.lit(1))


def punct_words(text: Column) -> Column:
    """Words between blanks without .,;:!?"'()[]{} at their ends; words of these alone stay as empty ones."""
    return F.transform(ws_words(text), lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()\[\]{}]+|[.,;:!?"'()\[\]{}]+$""", ""))


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def ngrams(words: Column, n: int, whole_if_short: bool = False) -> Column:
    """Distinct n-grams as text; a shorter text has none, or itself as the only one."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    short = F.array(F.array_join(words, " ")) if whole_if_short else F.array().cast("array<string>")
    return F.when(F.size(words) >= n, F.array_distinct(grams)).when(F.size(words) > 0, short).otherwise(F.array().cast("array<string>"))


def with_grams(df: DataFrame, words: Callable[[Column], Column], n: int, whole_if_short: bool = False, text: str = "text") -> DataFrame:
    """df with a column grams. The words are a column of their own first: inside a lambda they would be split again for every n-gram."""
    return df.withColumn("__words", words(F.col(text))).withColumn("grams", ngrams(F.col("__words"), n, whole_if_short)).drop("__words")


def gram_table(df: DataFrame, key: str) -> DataFrame:
    # explode() would bring a filter on the array's size, which is evaluated below the column of words
    return df.select(key, F.explode_outer("grams").alias("gram")).where(F.col("gram").isNotNull())


def gram_hashes(words: Column, n: int, whole_if_short: bool = False) -> Column:
    """Distinct 64-bit hashes of the n-grams, in the same cases."""
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= n, F.array_distinct(hashes)).when(F.size(words) > 0, F.array(F.xxhash64(words)) if whole_if_short else none).otherwise(none)


def hash_table(df: DataFrame, key: str, words: Callable[[Column], Column], n: int, whole_if_short: bool = False, text: str = "text") -> DataFrame:
    """key, gh, size: a row for each distinct n-gram hash of each row of df."""
    d = df.select(key, words(F.col(text)).alias("__words"))
    d = d.select(key, gram_hashes(F.col("__words"), n, whole_if_short).alias("__hashes"))
    return d.select(key, F.size("__hashes").alias("size"), F.explode_outer("__hashes").alias("gh")).where(F.col("gh").isNotNull())


def leaking(df: DataFrame, key: str, reference: DataFrame, words: Callable[[Column], Column], n: int, text: str = "text") -> DataFrame:
    """Distinct keys of rows of df that share an n-gram with a row of reference (both with the text column): by hash, then by the words themselves."""
    known = hash_table(reference.withColumn("__k", F.lit(0)), "__k", words, n, text=text).select("gh").distinct()
    suspects = hash_table(df, key, words, n, text=text).join(known, "gh", "left_semi").select(key).distinct()
    taken = gram_table(with_grams(df.select(key, text).join(suspects, key, "left_semi"), words, n, text=text), key)
    grams = gram_table(with_grams(reference.select(F.lit(0).alias("__k"), text), words, n, text=text), "__k").select("gram").distinct()
    return taken.join(grams, "gram", "left_semi").select(key).distinct()


def decontaminate(df: DataFrame, key: str, reference: DataFrame, words: Callable[[Column], Column], n: int, text: str = "text") -> DataFrame:
    return df.join(leaking(df, key, reference, words, n, text), key, "left_anti")


def decontaminate_groups(df: DataFrame, key: str, group: str, reference: DataFrame, words: Callable[[Column], Column], n: int, text: str = "text") -> DataFrame:
    """Without the whole group as soon as one member leaks."""
    bad = df.select(key, group).join(leaking(df, key, reference, words, n, text), key, "left_semi").select(group).distinct()
    return df.join(bad, group, "left_anti")


def overlap(queries: DataFrame, states: DataFrame, qkey: str, skey: str, words: Callable[[Column], Column], n: int, whole_if_short: bool = True) -> DataFrame:
    """For each query the state with most shared n-grams (ties: smallest key), and the Jaccard similarity of the two, over 64-bit hashes.

    Only states that share an n-gram are met, through an equi-join; the best is a maximum, combined before rows are shuffled.
    """
    q = hash_table(queries, qkey, words, n, whole_if_short).withColumnRenamed("size", "nq")
    s = hash_table(states, skey, words, n, whole_if_short).withColumnRenamed("size", "ns")
    hits = q.join(s, "gh").groupBy(qkey, skey, "nq", "ns").agg(F.count(F.lit(1)).alias("shared"))
    best = hits.groupBy(qkey).agg(F.max_by(F.struct(skey, "shared", "nq", "ns"), F.struct("shared", -F.col(skey))).alias("b"))
    return best.select(qkey, f"b.{skey}", "b.shared", F.round(F.col("b.shared") / (F.col("b.nq") + F.col("b.ns") - F.col("b.shared")), 6).alias("jaccard"))
