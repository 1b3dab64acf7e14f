"""The corpus pipeline: from documents to packed training sequences.

Each stage takes all documents that its predecessor kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadscope.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from loadscope.session import write_table

#: Vocabulary of the packed sequences, and the id that ends a document.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id."""
    return exact_dedup.unique(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five words, similarity 0.8): the smallest id."""
    return ngram_join.unique(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in the order of training."""
    return mixing.curriculum(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=END_ID, window=2048)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores and packing by retrieval have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
