"""A training corpus from raw documents: five stages, each one of the operators of gavelflow.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Each works on all its predecessor kept.

Defined results, for run() as for each stage: null and empty texts are kept
where nothing else rejects them (of texts without words one of each equal text
stays); documents of equal id and text are one from the near dedup on; null ids,
sources and other columns pass through; columns beyond those of documents pass
through as well, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gavelflow.llm import line_dedup, mixing, near_dedup, packing, toxicity
from gavelflow.llm.common import cut, drop_cut, scratch
from gavelflow.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on labelled documents, does not reject."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs and of single lines that are passages."""
    return line_dedup.clean(docs, passage_words=line_dedup.PASSAGE_WORDS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, each at least once."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: a row for each piece of a document."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned weights, sketches and packing are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage leaves behind goes once its result is written
            docs = cut(stage(spark, docs, sf_dir))
            keep.add(docs.cut_path)
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
