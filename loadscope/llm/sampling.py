"""A bounded, repeatable sample of rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.functions.randomness import HASH_BITS, hash52


def first_by_hash(rows: DataFrame, row_id: str, most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of their id; null ids come as one id.

    Rows are counted first and most are left out where they lie, so that about
    ``most`` rows, not as many from every task, meet in the task that cuts them.
    """
    key = hash52(F.coalesce(F.col(row_id).cast("string"), F.lit("")), "sample")
    share = min(1.0, 1.2 * most / max(1, rows.count()))
    few = rows.withColumn("_key", key).where(F.col("_key") <= int(share * (1 << HASH_BITS)))
    return few.orderBy("_key", row_id).limit(most).drop("_key")
