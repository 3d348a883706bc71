"""Corpus pipeline: toxic documents go, then those in another language than stated, then near
copies, then passages seen before; what is left is packed into windows.

Each stage's rows are written and become the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import jaccard, language, packing, substring, toxicity
from quire.llm.shared import read_table, save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def drop_other_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text does not contradict their stated language."""
    return language.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones."""
    return jaccard.keep_first(docs)


def drop_seen_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long passages of earlier ones."""
    return substring.keep_unseen(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1,024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_other_languages),
    ("jaccard", drop_near_copies),
    ("substring", drop_seen_passages),
    ("packing", pack),
]

# Learned scores and iterative joins are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, writing each result to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
