"""Checks that fire whatever columns are read afterwards.

A check inside an output column goes when the column is pruned. Here it sits in a
filter, which no plan may leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_rows(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """``df``, or an error when a row does not hold."""
    failed = F.raise_error(F.lit(message)).cast("boolean")
    return df.where(F.when(holds, F.lit(True)).otherwise(failed))


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """``df``, or an error when a scalar does not hold, also when ``df`` has no rows.

    The check is a branch of one row that is evaluated and then dropped.
    """
    failed = F.raise_error(F.lit(message)).cast("boolean")
    none = df.sparkSession.range(1).where(F.when(holds, F.lit(False)).otherwise(failed))
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
