"""Exact quantiles of groups of any size, on one path for every size.

``percentile`` keeps every distinct value of a group in one task. Here a bracket
around each rank is narrowed by counting its values into at most ``BINS`` bins:

* first into logarithmic bins, ``PER_OCTAVE`` to a factor of two and one histogram for
  all quantiles of a group, so every bracket lies within a sixteenth of an octave, where
  at most about 2**48 doubles differ;
* then twice into equal parts of the bracket, which leaves about 2**16 different doubles
  whatever the data are;
* then by value, which gives the value at the rank.

The values of a bin combine before the shuffle, and one task orders the bins of one
bracket: a bound that does not depend on the number of rows. Both kinds of bins are
monotone in floating point, so the result is exact. Only values inside a bracket are
counted for it; a bin keeps its smallest value, so the next larger value is known
without a search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_OCTAVE = 16
BINS = 1 << 16
#: Rounds into equal parts; two leave about as many different doubles as there are bins.
ROUNDS = 2
#: Logarithms of infinity and NaN are set to this; those of finite doubles are below 1024.
_TOP = 1100.0
_ZERO = 20_000

Aggregate = Callable[[str], Column]


def quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probs: dict[str, float],
    *,
    extra: dict[str, Aggregate] | None = None,
    rounds: int = ROUNDS,
    bins: int = BINS,
) -> DataFrame:
    """Linear-interpolated quantiles ``{out: p}`` per key and column, NULLs skipped.

    One row per key and column: ``*keys, metric, n, *extra, *probs``, where
    ``metric`` is the column's name. ``extra`` aggregates (numbers such as means
    and deviations) run with the counts. All columns share every pass.
    """
    extra = extra or {}
    wanted = sorted(set(probs.values()))
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in columns])
    values = rows.select(*keys, F.explode(entries).alias("_m")).select(*keys, "_m.*").where("x is not null")
    group = [*keys, "metric"]

    facts = _facts(rows, keys, columns, extra)
    brackets = _logarithmic(values, group, wanted)
    for _ in range(rounds):
        brackets = _narrowed(values, brackets, group, bins)
    found = _read_off(values, brackets, group)

    wide = found.groupBy(*[F.col(k).alias(f"_key_{k}") for k in group]).agg(
        *[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"_v{i}") for i in range(len(wanted))]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in group]
    outs = [F.col(f"_v{wanted.index(p)}").alias(out) for out, p in probs.items()]
    return facts.join(wide, same, "left").select(*group, "n", *extra, *outs)


def _facts(rows: DataFrame, keys: list[str], columns: list[str], extra: dict[str, Aggregate]) -> DataFrame:
    """``*keys, metric, n, *extra``; an empty input without keys has its rows of zeros too."""
    per_column = rows.groupBy(*keys).agg(
        *[F.struct(F.lit(c).alias("metric"), F.count(c).alias("n"), *[fn(c).alias(name) for name, fn in extra.items()]).alias(c) for c in columns]
    )
    return per_column.select(*keys, F.explode(F.array(*columns)).alias("_f")).select(*keys, "_f.*")


def _logarithmic(values: DataFrame, group: list[str], wanted: list[float]) -> DataFrame:
    """The first bracket of every rank: ``*group, i, at, low, high, before, next``.

    ``before`` counts the values below the bracket, ``next`` is the smallest above it.
    """
    x = F.col("x")
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(_TOP)) * PER_OCTAVE) + _ZERO
    binned = values.withColumn("_bin", F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)))
    counted = binned.groupBy(*group, "_bin").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
    placed = _placed(counted.withColumn("before", F.lit(0).cast("bigint")).withColumn("next", F.lit(None).cast("double")), group, "_bin")
    total = F.sum("c").over(W.partitionBy(*group))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (total - 1)).alias("at")) for i, p in enumerate(wanted)])
    asked = placed.withColumn("_ranks", ranks)
    hit = F.filter("_ranks", lambda r: _covers(F.floor(r["at"])))
    return asked.select(*group, F.explode(hit).alias("_r"), "low", "high", "before", "next").select(
        *group, "_r.i", "_r.at", "low", "high", "before", "next"
    )


def _placed(counted: DataFrame, one: list[str], order: str) -> DataFrame:
    """``before`` and ``upto`` of every bin, and the smallest value above it."""
    by = W.partitionBy(*one).orderBy(order)
    upto = F.col("before") + F.sum("c").over(by.rowsBetween(W.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).withColumn("next", F.coalesce(F.lead("low").over(by), "next"))
    return placed.withColumn("before", F.col("upto") - F.col("c"))


def _covers(rank: Column) -> Column:
    return (F.col("before") <= rank) & (rank < F.col("upto"))


def _within(values: DataFrame, brackets: DataFrame, group: list[str]) -> DataFrame:
    """Every value once per bracket that holds it; one row per group is joined.

    No hint: the runtime size of the brackets decides between a broadcast and a
    skew-split join.
    """
    held = brackets.groupBy(*[F.col(k).alias(f"_key_{k}") for k in group]).agg(
        F.collect_list(F.struct("i", "at", "low", "high", "before", "next")).alias("_b")  # one per quantile asked for
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in group]
    x = F.col("x")
    inside = F.filter("_b", lambda b: (x >= b["low"]) & (x <= b["high"]))
    return values.join(held, same).select(*group, "x", F.explode(inside).alias("_b")).select(*group, "x", "_b.*")


def _narrowed(values: DataFrame, brackets: DataFrame, group: list[str], bins: int) -> DataFrame:
    """Of ``bins`` equal parts of every bracket, the one that holds the rank."""
    one = [*group, "i"]
    # a bracket of one value has no width, and that of infinity and NaN no finite one: one bin
    share = (F.col("x") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    binned = _within(values, brackets, group).withColumn("_bin", F.coalesce(F.floor(share * bins), F.lit(0)))
    counted = binned.groupBy(*one, "_bin").agg(
        F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"), *[F.min(c).alias(c) for c in ("at", "before", "next")]
    )
    placed = _placed(counted, one, "_bin")
    return placed.where(_covers(F.floor("at"))).select(*one, "at", "low", "high", "before", "next")


def _read_off(values: DataFrame, brackets: DataFrame, group: list[str]) -> DataFrame:
    """``*group, i, value`` from the ordered values inside the brackets."""
    one = [*group, "i"]
    counted = _within(values, brackets, group).groupBy(*one, F.col("x").alias("low")).agg(
        F.count("*").alias("c"), *[F.min(c).alias(c) for c in ("at", "before", "next")]
    )
    at, lower = F.col("at"), F.col("low")
    here = _placed(counted, one, "low").where(_covers(F.floor(at)))
    upper = F.when(F.ceil(at) < F.col("upto"), lower).otherwise(F.col("next"))
    between = F.when(upper == lower, lower).otherwise(lower + (upper - lower) * (at - F.floor(at)))
    return here.select(*one, between.alias("value"))
