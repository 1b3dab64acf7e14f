"""Arrival schedules: generated, replayed, sliced, rescaled and summarised."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.randomness import uniform
from loadscope.operators import ordered
from loadscope.operators.checks import require
from loadscope.session import write_table

SECOND_US = 1_000_000
SECOND_NS = 1e9
SAMPLE_SEED = 42
_EMIT = 8192
#: Whole and half shapes up to this are drawn by column expressions.
HALVES = 16


# -- generated ------------------------------------------------------------------


def _interval_ns(row_id: Column, rate: float, seed) -> Column:
    """Exponential interval as whole nanoseconds, so that sums do not depend on order."""
    seconds = -F.ln(F.lit(1.0) - uniform(row_id, seed)) / F.lit(float(rate))
    return F.round(seconds * F.lit(SECOND_NS)).cast("bigint")


def _seconds(ns: Column) -> Column:
    """Whole nanoseconds as seconds with 6 decimals, rounded half up in integers."""
    up = ns + 500
    return (up - F.pmod(up, F.lit(1000))) / F.lit(SECOND_NS)


def poisson(requests: DataFrame, row_id: str, rate: float, seed) -> DataFrame:
    """Arrival times of a Poisson process in id order; the first is one interval after 0."""
    rows = requests.withColumn("_ns", _interval_ns(F.col(row_id), rate, seed))
    summed = ordered.prefix_sum(rows, row_id, "_ns", "_sum")
    return summed.withColumn("arrival_time", _seconds(F.col("_sum"))).drop("_ns", "_sum")


def _mix(state: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: one uniform word per counter value."""
    with np.errstate(over="ignore"):
        z = state + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def gamma_draws(ids: np.ndarray, shape: float, seed: int) -> np.ndarray:
    """Unit-scale gamma variates, a function of (seed, id) alone (Marsaglia and Tsang, 2000)."""
    base = _mix(_mix(np.full(len(ids), seed, dtype=np.uint64)) ^ ids.astype(np.uint64))

    def uniforms(rows: np.ndarray, draw: int) -> np.ndarray:
        words = _mix(base[rows] ^ _mix(np.full(len(rows), draw, dtype=np.uint64)))
        return ((words >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)

    boosted = shape if shape >= 1 else shape + 1
    d = boosted - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out = np.zeros(len(ids))
    todo, draw = np.arange(len(ids)), 1
    while len(todo):
        u1, u2, u3 = (uniforms(todo, draw + k) for k in range(3))
        normal = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + c * normal) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            accept = (v > 0) & (np.log(u3) < 0.5 * normal**2 + d - d * v + d * np.log(v))
        out[todo[accept]] = d * v[accept]
        todo, draw = todo[~accept], draw + 3
    if shape < 1:
        out *= uniforms(np.arange(len(ids)), 0) ** (1 / shape)
    return out


def _half_gamma(row_id: Column, shape: float, seed) -> Column:
    """Unit-scale gamma variate for a whole or half shape: exponentials, and half a squared normal."""
    draw = lambda k: uniform(row_id, f"{seed}g{k}")
    parts = [-F.ln(F.lit(1.0) - draw(k)) for k in range(int(shape))]
    if shape != int(shape):
        wave = F.cos(F.lit(2 * math.pi) * draw("b"))
        parts.append(-F.ln(F.lit(1.0) - draw("a")) * wave * wave)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def bursty(requests: DataFrame, row_id: str, rate: float, seed: int, burstiness: float = 1.0) -> DataFrame:
    """Gamma-distributed intervals with mean ``1/rate``; the first request is at 0.

    ``burstiness`` is the shape: 1 is a Poisson process, less is burstier. An
    infinite rate sends everything at 0.
    """
    if burstiness <= 0:
        raise ValueError(f"burstiness must be positive, not {burstiness}")
    if math.isinf(rate):
        return requests.withColumn("arrival_time", F.lit(0.0))
    if burstiness == 1.0:
        interval = _interval_ns(F.col(row_id), rate, seed)
    elif (2 * burstiness).is_integer() and burstiness <= HALVES:
        interval = F.round(_half_gamma(F.col(row_id), burstiness, seed) * F.lit(SECOND_NS / (rate * burstiness))).cast("bigint")
    else:
        scale_ns = SECOND_NS / (rate * burstiness)

        @F.pandas_udf("bigint")
        def draw(ids: pd.Series) -> pd.Series:
            return pd.Series(np.rint(gamma_draws(ids.to_numpy(), burstiness, seed) * scale_ns).astype("int64"))

        interval = draw(F.col(row_id))
    rows = requests.withColumn("_ns", interval)
    summed = ordered.prefix_sum(rows, row_id, "_ns", "_sum", inclusive=False)
    return summed.withColumn("arrival_time", _seconds(F.col("_sum"))).drop("_ns", "_sum")


# -- replayed -------------------------------------------------------------------


def rebase(log: DataFrame, column: str) -> DataFrame:
    """Subtract the column's own minimum."""
    return log.withColumn(column, F.col(column) - log.agg(F.min(column).alias("m")).scalar())


def replay(
    log: DataFrame, time_us: str, target_rate: float, n: int, seed, *, on_short: str = "raise"
) -> DataFrame:
    """``n`` arrivals with the shape of a log, scaled to ``target_rate`` per second.

    Every 1-second bucket is scaled and rounded up with the probability of its
    fraction. A schedule that is too short raises, or with ``on_short='wrap'``
    starts over at its last second, or with ``on_short='end'`` ends with the log.
    """
    if on_short not in ("raise", "wrap", "end"):
        raise ValueError(f"on_short is 'raise', 'wrap' or 'end', not {on_short!r}")
    rebased = rebase(log.select(F.col(time_us).alias("t")), "t")
    # one row per second of the log: factor, length, laps and the cut all come from it
    seconds = write_table(
        rebased.groupBy(F.floor(F.col("t") / SECOND_US).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.count("t").alias("stamped"), F.max("t").alias("high")),
        "seconds",
    )
    stats = seconds.agg(
        F.struct(F.coalesce(F.sum("stamped"), F.lit(0)).alias("rows"), (F.max("high") / F.lit(float(SECOND_US))).alias("last")).alias("s")
    ).scalar()
    # count / (count / last) = last: the mean rate cancels only in exact arithmetic, so keep both steps.
    factor = F.lit(float(target_rate)) / (F.col("s.rows") / F.col("s.last"))
    buckets = (
        seconds.select("bucket", "rows")
        .withColumn("s", stats)
        .where(F.col("bucket") < F.ceil("s.last"))
        .withColumn("x", F.col("rows") * factor)
        .withColumn("size", (F.floor("x") + (uniform(F.col("bucket"), seed) <= F.col("x") - F.floor("x")).cast("int")).cast("bigint"))
        .where("size > 0")
        .select("bucket", "size")
    )
    placed = ordered.prefix_sum(buckets, "bucket", "size", "first", inclusive=False)
    total = buckets.agg(
        F.struct(F.coalesce(F.sum("size"), F.lit(0)).alias("length"), F.max("bucket").alias("last")).alias("t")
    ).scalar()
    wanted = placed.withColumn("t", total)
    if on_short != "wrap":
        laps = wanted.withColumn("lap", F.lit(0).cast("bigint"))
    else:
        needed = F.ceil(F.lit(float(n)) / F.col("t.length"))
        laps = _spread(wanted.withColumn("laps", F.greatest(needed, F.lit(1))), "laps", "lap", ["bucket"])
    # Arrivals past n are cut before they are emitted.
    start = F.col("first") + F.col("lap") * F.col("t.length")
    cut = laps.withColumn("start", start).where(F.col("start") < n)
    cut = cut.withColumn("size", F.least("size", F.lit(n) - F.col("start")))
    second = F.col("bucket") + F.col("lap") * F.col("t.last")
    arrivals = _spread(cut.select("start", "size", second.alias("second")), "size", "i", ["second", "start"])
    out = arrivals.select(
        (F.col("start") + F.col("i")).cast("bigint").alias("ordinal"),
        F.col("second").cast("double").alias("arrival_time"),
    )
    if on_short != "raise":
        return out
    length = buckets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).scalar()
    return require(out, length >= n, f"the scaled log has fewer than {n} arrivals")


def _spread(rows: DataFrame, count: str, out: str, by: list[str]) -> DataFrame:
    """Every row ``count`` times, numbered from 0.

    A row with a huge count is unfolded in chunks that are dealt out to several
    tasks before the copies exist.
    """
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / _EMIT)))
    dealt = rows.select("*", chunk.alias("_chunk")).repartition(*by, "_chunk")
    first = F.col("_chunk") * _EMIT
    last = F.least(first + (_EMIT - 1), F.col(count) - 1)
    return dealt.select("*", F.explode(F.sequence(first, last)).alias(out)).drop("_chunk")


# -- sliced and rescaled --------------------------------------------------------


def time_slice(log: DataFrame, column: str, duration: float, seed) -> DataFrame:
    """Rows of a random window ``[start, start + duration)``, rebased to its start.

    The log must be longer than the window.
    """
    bounds = log.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if bounds["low"] is None or bounds["high"] - duration <= bounds["low"]:
        raise ValueError(f"the log is not long enough for a slice of {duration} seconds")
    low, room = float(bounds["low"]), float(bounds["high"]) - duration - float(bounds["low"])
    start = F.lit(low) + uniform(F.lit("slice"), seed) * F.lit(room)
    t = F.col(column)
    inside = log.withColumn("_start", start).where((t >= F.col("_start")) & (t < F.col("_start") + duration))
    return inside.withColumn(column, t - F.col("_start")).drop("_start")


def min_gap(log: DataFrame, column: str) -> DataFrame:
    """Smallest difference between consecutive time stamps, in one row.

    Equal time stamps collapse first: they give a gap of 0 without being ordered.
    """
    stamps = log.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    gaps = ordered.lag(stamps, [column], {"_previous": column})
    own = F.when(F.col("_rows") > 1, F.col(column) - F.col(column))
    return gaps.agg(F.least(F.min(F.col(column) - F.col("_previous")), F.min(own)).alias("min_gap"))


def mean_gap(schedule: DataFrame, column: str = "arrival_time") -> DataFrame:
    """Mean inter-arrival time; it telescopes, so no order is needed."""
    t = F.col(column)
    return schedule.agg(F.try_divide(F.max(t) - F.min(t), F.count(t) - 1).alias("mean_gap"))


def sample_exactly(log: DataFrame, row_id: Column, n: int, seed) -> DataFrame:
    """Exactly ``n`` rows without replacement (all of them when there are fewer)."""
    return ordered.hash_first(log, row_id, seed, n)


def upsample(log: DataFrame, row_id: str, column: str, n: int, have: int, seed) -> DataFrame:
    """``n`` rows from copies of ``have`` rows; copies after the first are jittered.

    The jitter stays under a tenth of the smallest gap.
    """
    copies = math.ceil(n / have)
    gap = min_gap(log, column).scalar()
    copied = _spread(log.withColumn("_copies", F.lit(copies)), "_copies", "copy", [row_id])
    copied = copied.withColumn("copy", F.col("copy").cast("int")).drop("_copies")
    twin = F.concat(F.col(row_id).cast("string"), F.lit("-"), F.col("copy").cast("string"))
    jitter = F.when(F.col("copy") > 0, uniform(twin, f"jitter{seed}") * gap / 10).otherwise(0.0)
    return sample_exactly(copied.withColumn(column, F.col(column) + jitter), twin, n, seed)


def scale_rate(
    log: DataFrame, row_id: str, column: str, target_rate: float, seed=SAMPLE_SEED
) -> DataFrame:
    """A log starting at 0 brought to ``target_rate`` per second over the same duration.

    Reads one row of counts, then samples down, copies up or keeps the rows, and
    rebases to the first arrival. ``copy`` tells copies apart. The sample is a filter on
    the hash of the row, so that nothing is written and no row is shuffled for it.
    """
    stats = log.agg(F.count(F.lit(1)).alias("n"), F.max(column).alias("duration")).first()
    have, target = stats["n"], int(target_rate * (stats["duration"] or 0.0))
    if target < have:
        scaled = sample_exactly(log, F.col(row_id), target, seed).withColumn("copy", F.lit(0))
    elif target > have:
        scaled = upsample(log, row_id, column, target, have, seed)
    else:
        scaled = log.withColumn("copy", F.lit(0))
    return rebase(scaled, column)


# -- summarised -----------------------------------------------------------------


def rate_histogram(
    log: DataFrame, column: str, width: float = 5, weight: str | None = None
) -> DataFrame:
    """Rows (or ``weight``) per second in bins of ``width`` seconds from 0.

    Empty bins are kept and the last bin is closed on the right.
    """
    bins = log.agg(F.ceil(F.max(column) / width).cast("bigint").alias("bins"))
    last = F.greatest(bins.scalar(), F.lit(1)) - 1
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        log.where(F.col(column) >= 0)
        .withColumn("_last", last)
        .groupBy(F.least(F.floor(F.col(column) / width), F.col("_last")).alias("bin"))
        .agg(amount.alias("amount"))
    )
    # the axis grows with the time span, so it is unfolded in chunks by several tasks
    axis = _spread(bins.where(F.col("bins").isNotNull()).select(F.greatest("bins", F.lit(1)).alias("bins")), "bins", "bin", [])
    return axis.join(counted, "bin", "left").select(
        "bin",
        (F.col("bin") * width + width / 2).cast("double").alias("center"),
        (F.coalesce("amount", F.lit(0)) / width).alias("rate"),
    )


def rate_report(log: DataFrame, column: str) -> DataFrame:
    """Count, duration and mean rate of a log that starts at 0."""
    return log.agg(F.count(column).alias("requests"), F.max(column).cast("double").alias("duration_s")).withColumn(
        "rate", F.try_divide(F.col("requests"), F.col("duration_s"))
    )
