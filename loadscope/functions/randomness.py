"""Seeded randomness that depends only on the row id, never on partitioning.

A task that is retried, or a plan with another number of partitions, draws the
same numbers again, which ``rand(seed)`` does not promise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52
HASH_SPACE = float(1 << HASH_BITS)


def hash52(row_id: Column, salt) -> Column:
    """52 uniform bits as a bigint, from the md5 of ``id:salt``."""
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.md5(F.concat(row_id.cast("string"), F.lit(":"), salt.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def uniform(row_id: Column, salt) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (hash52(row_id, salt) + F.lit(0.5)) / F.lit(HASH_SPACE)


def choice(options: list[str], row_id: Column, salt) -> Column:
    """One of a fixed list of options, chosen per row."""
    picks = F.array(*[F.lit(o) for o in options])
    return F.get(picks, F.floor(uniform(row_id, salt) * len(options)).cast("int"))
