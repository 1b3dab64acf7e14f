"""Conversation and text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope import schemas


def read_conversations(spark: SparkSession, path: str, *, single_document: bool = False) -> DataFrame:
    """Nested conversations from JSON lines, or from one JSON array per file.

    A single document cannot be split between tasks; convert a large one to
    lines or Parquet once with :func:`to_lines`.
    """
    return spark.read.schema(schemas.CONVERSATIONS).option("multiLine", single_document).json(path)


def to_lines(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("errorifexists").json(path)


def read_chat_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHAT_CORPUS).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A hub data set's split, stored as Parquet."""
    return spark.read.parquet(path)


def to_turns(corpus: DataFrame, row_id: str) -> DataFrame:
    """Nested conversations as one row per turn."""
    return corpus.select(F.col(row_id).alias("conv_id"), F.posexplode("conversations")).select(
        "conv_id", F.col("pos").alias("turn"), F.col("col.from").alias("from"), F.col("col.value").alias("value")
    )
