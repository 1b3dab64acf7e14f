"""Registration of queries and composition of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.catalog.inputs import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs)``; ``sql`` may use the derived views of ``inputs``."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns (all doubles when none is named) for comparison."""
    names = set(cols) or {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    picked: list[Column] = [
        F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns
    ]
    return df.select(*picked)
