"""The document pipeline: each stage's result is written as Parquet and reread
as the next stage's input.

A stage takes (spark, docs, sf_dir) and returns the documents that go on, with the
columns doc_id, text, lang, source and n_chars; the last returns the pieces of the
packed sequences. Defined cases are those of the operators: null or empty texts
score as texts without features, and fail the quality rules; rows without an id pass the
near-duplicate stage; an empty table goes through as one; columns beyond those of
``documents`` are dropped by the first stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsense.llm.common import documents, scratch
from tabsense.llm.minhash import one_of_each
from tabsense.llm.packing import pack
from tabsense.llm.quality import keep_good
from tabsense.llm.suffix import without_repeats
from tabsense.llm.toxicity import not_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, 0.8."""
    return one_of_each(docs, size=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 400-byte strings that occur more than once."""
    return without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("packing", packing_stage),
]

#: no stage's verdict can be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
