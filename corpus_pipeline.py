"""A corpus pipeline of five stages over `documents`; each takes all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import jaccard, packing, quality, substrings, tables, toxicity
from glyphlake.llm.queries import toxicity_model, vocabulary


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on their labelled rows, doesn't call toxic."""
    return toxicity.keep(docs, toxicity_model(spark, sf_dir, docs))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest doc_id."""
    return jaccard.one_of_each(docs)


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document of smaller doc_id has; n_chars is counted anew."""
    return substrings.apply(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality_rules", stage_quality),
    ("ngram_jaccard", stage_near_duplicates),
    ("substring_dedup", stage_substrings),
    ("packing", stage_packing),
]

#: The toxicity model and the tokenizer can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = tables.written(spark, stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
