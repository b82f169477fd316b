"""License scan by diagonal voting, DataFrame functions only.

Every pair of neighbouring words of a text is hashed and joined to the
template positions that hold the pair; the words themselves are compared at
once, so a hash never decides alone. A hit votes for the diagonal (text
position minus template position). A phrase stands where a diagonal has all
its votes. For the longer templates neighbouring diagonals are merged, so a
word more or less does not break a match, and the merged span must hold most
of the template's pairs within little more than its length.

Defined results: a null text is empty and has no labels; repeated rows of one
doc_id and text each get their own row; doc_id may be null; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences by which well-known licenses are recognised.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc",
}

#: Words so frequent that a pair of them is no sign of a license.
COMMON = set("the of and a to is in it or this for any by as with may not".split())


def template_grams(spark: SparkSession) -> DataFrame:
    """A row for each indexed word pair of a template: fixed, under two hundred rows, hence broadcast."""
    rows = []
    for n, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        w = text.split()
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(w, w[1:])) if text in PHRASES or not (a in COMMON and b in COMMON)]
        mask = sum(1 << i for i, _, _ in pairs)
        rows += [(n, label, text in PHRASES, i, 1 << i, a, b, mask, len(w)) for i, a, b in pairs]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, tpos int, bit long, w1 string, w2 string, full long, width int")
    return F.broadcast(t.withColumn("gram", F.xxhash64("w1", "w2")))


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case. The Kelvin sign, whose lower case is an ASCII k, is kept out of them."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ÿ"))), SEPARATORS), "")


def license_scan(docs: DataFrame, slack: int = 2, share: float = 0.6) -> DataFrame:
    """A row for each row of docs: places of the phrases, labels, score.

    slack: diagonals at most so far apart are merged. share: least part of a
    template's pairs that a merged span must hold; its length may be up to
    1/share times the template's.
    """
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))
    d = d.select("doc_id", "h", "words", F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "w"))
    d = d.withColumn("next", F.get("words", F.col("pos") + 1)).withColumn("gram", F.when(F.col("next").isNotNull(), F.xxhash64("w", "next")))
    t = template_grams(docs.sparkSession)
    hit = F.col("w").isNull() | ((F.col("w") == F.col("w1")) & (F.col("next") == F.col("w2")))
    votes = d.join(t, "gram", "left").where(hit).groupBy("doc_id", "h", "template", "label", "base", "full", "width", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    # the null that ends each text's words votes for no template: it counts the text's rows and words
    votes = votes.agg(F.bit_or("bit").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_if(F.col("w").isNull()).alias("rows"))
    place = F.col("base") & (F.col("votes") == F.col("full"))
    w = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    votes = votes.withColumn("island", F.sum((F.col("diagonal") - F.lag("diagonal").over(w) > slack).cast("int")).over(w))
    merged = votes.groupBy("doc_id", "h", "template", "label", "base", "full", "width", F.coalesce("island", F.lit(0)).alias("island")).agg(
        F.bit_or("votes").alias("votes"), F.max(F.col("hi") + 2).alias("hi"), F.min("lo").alias("lo"), F.max("rows").alias("rows"), F.max(F.when(F.col("template").isNull(), F.col("hi"))).alias("n_words"),
        F.count_if(place).alias("places"), F.min(F.when(place, F.col("diagonal"))).alias("first"), F.max(F.when(place, F.col("diagonal"))).alias("last"),
    )
    held = F.bit_count("votes") / F.bit_count("full")
    span = ~F.col("base") & (held >= share) & (F.col("hi") - F.col("lo") <= F.col("width") / share)
    out = merged.groupBy("doc_id", "h").agg(
        F.max("rows").alias("rows"), F.max("n_words").cast("long").alias("n_words"), F.sum("places").cast("long").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("places") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("places") > 0) | span, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("places") > 0, F.lit(1.0)).when(span, held)), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))).drop("h", "rows", "copy")
