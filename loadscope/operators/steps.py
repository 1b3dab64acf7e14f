"""Step-log metrics: step times, throughput series, fine-tuning throughput and overheads.

Step-to-step differences need the log in time order, over the whole table or per
run. The order always ends in ``step_id``, and :mod:`ordered` cuts it into even
runs, so neither a run with most of the steps nor a burst of equal time stamps
lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.operators import ordered
from loadscope.operators.checks import require_rows
from loadscope.operators.quantiles import quantiles

# The measured grid and the load a measured step carries.
FWD_TOKENS = (0, 1024, 2048, 3072, 4096)
BWD_LAYERS = (0, 8, 16, 24, 32)
DECODING_TOKENS = 256
BWD_TOKENS = 4096

# Request-id layout of the overhead runs.
FIRST_GUID, WARMUP_REQUESTS, REQUESTS_PER_RUN = 1_000_000, 11, 8


def _is_not(column: str, value: int) -> Column:
    """``<>`` that keeps NULL."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def ft_throughput(log: DataFrame, *, strict: bool = False) -> DataFrame:
    """Forward fine-tuning tokens per second over the span of the fine-tuning steps.

    Forward and backward tokens must be equal; ``strict`` raises when they are not.
    """
    fwd, bwd = F.col("num_finetuning_fwd_tokens"), F.col("num_finetuning_bwd_tokens")
    steps = log.where((F.col("is_warmup_step") == 0) & (F.col("run_idx") > 0) & ((fwd > 0) | (bwd > 0)))
    out = steps.agg(
        F.coalesce(F.sum(fwd), F.lit(0)).alias("fwd_tokens"),
        F.coalesce(F.sum(bwd), F.lit(0)).alias("bwd_tokens"),
        ((F.max("timestamp_us") - F.min("timestamp_us")) / F.lit(1e6)).alias("duration_s"),
    ).withColumn("is_balanced", F.col("fwd_tokens") == F.col("bwd_tokens"))
    if strict:
        out = require_rows(out, F.col("is_balanced"), "forward and backward fine-tuning tokens differ")
    return out.withColumn("throughput", F.try_divide("fwd_tokens", "duration_s"))


def throughput_series(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Decoded tokens per second of every step but the first, with time since the second step.

    Steps that share a time stamp have no rate (NULL). Like the first step, a row
    with a NULL in any other column is left out.
    """
    keys = keys or []
    steps = log.where(
        _is_not("run_idx", 0) & _is_not("is_warmup_step", 1) & _is_not("num_decoding_tokens", 0)
    )
    stepped = ordered.lag(steps, ["timestamp_us", "step_id"], {"_previous": "timestamp_us"}, keys=keys)
    diff = (F.col("timestamp_us") - F.col("_previous")) / F.lit(1e6)
    rows = stepped.withColumn("time_diff_sec", diff).drop("_previous").dropna()
    rows = rows.withColumn("throughput", F.try_divide(F.col("num_decoding_tokens"), "time_diff_sec"))
    first = F.min("timestamp_us").alias("_first")
    if keys:
        starts = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(first)
        same_key = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        rows = rows.join(starts, same_key).drop(*[f"_key_{k}" for k in keys])
    else:
        rows = rows.withColumn("_first", rows.agg(first).scalar())
    relative = (F.col("timestamp_us") - F.col("_first")) / F.lit(1e6)
    return rows.withColumn("relative_time", relative).drop("_first")


def describe_throughput(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of a throughput series."""
    stats = quantiles(
        series, keys or [], ["throughput"], {"p25": 0.25, "p50": 0.5, "p75": 0.75},
        extra={"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
    )
    return stats.select(
        *(keys or []), F.col("n").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def step_times(log: DataFrame) -> DataFrame:
    """Milliseconds since the previous step of the same run, before any selection of steps."""
    steps = log.where((F.col("run_idx") >= 1) & _is_not("is_warmup_step", 1))
    stepped = ordered.lag(
        steps, ["timestamp_us", "step_id"], {"_previous": "timestamp_us"}, keys=["run_idx"]
    )
    diff = (F.col("timestamp_us") - F.col("_previous")) / F.lit(1e3)
    return stepped.withColumn("step_time_ms", diff).drop("_previous")


def grid(spark: SparkSession, column: str, values: tuple[int, ...]) -> DataFrame:
    """The expected values as rows."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


def _overhead(times: DataFrame, column: str, values: tuple[int, ...]) -> DataFrame:
    per_run = times.groupBy("run_idx", column).agg(F.avg("step_time_ms").alias("run_mean"))
    per_value = per_run.groupBy(column).agg(
        F.avg("run_mean").alias("step_time_ms"), F.count("run_mean").alias("runs")
    )
    # At most one row per grid value on either side.
    return (
        grid(times.sparkSession, column, values)
        .join(F.broadcast(per_value.where(F.col(column).isin(*values))), column, "left")
        .select(column, "step_time_ms", F.coalesce("runs", F.lit(0)).alias("runs"))
    )


def _plain_decoding(times: DataFrame) -> DataFrame:
    return times.where(
        (F.col("num_decoding_tokens") == DECODING_TOKENS) & (F.col("num_prefilling_tokens") == 0)
    )


def fwd_overhead(times: DataFrame, values: tuple[int, ...] = FWD_TOKENS) -> DataFrame:
    """Mean over runs of the mean step time, per number of forward fine-tuning tokens."""
    steps = _plain_decoding(times).where(F.col("num_finetuning_bwd_tokens") == 0)
    return _overhead(steps, "num_finetuning_fwd_tokens", values)


def bwd_overhead(
    times: DataFrame, values: tuple[int, ...] = BWD_LAYERS, bwd_tokens: int = BWD_TOKENS
) -> DataFrame:
    """The same per number of backward layers, for steps with the full backward load."""
    steps = _plain_decoding(times).where(
        (F.col("num_finetuning_fwd_tokens") == 0) & (F.col("num_finetuning_bwd_tokens") == bwd_tokens)
    )
    return _overhead(steps, "num_bwd_layers", values)


def run_index(fwd_tokens: Column, bwd_layers: Column, *, strict: bool = True) -> Column:
    """1-based position in the forward x backward grid; an unknown value raises, or is NULL."""
    at_fwd = F.array_position(F.array(*[F.lit(v) for v in FWD_TOKENS]), fwd_tokens)
    at_bwd = F.array_position(F.array(*[F.lit(v) for v in BWD_LAYERS]), bwd_layers)
    index = (1 + (at_fwd - 1) * len(BWD_LAYERS) + at_bwd - 1).cast("int")
    known = (at_fwd > 0) & (at_bwd > 0)
    unknown = F.raise_error(F.lit("value outside the measured grid")) if strict else F.lit(None)
    return F.when(known, index).otherwise(unknown.cast("int"))


def guid_ranges(spark: SparkSession) -> DataFrame:
    """Request ids of every run: warm-ups first, then 8 per run, plus 1 where forward tokens run."""
    cells = grid(spark, "num_finetuning_fwd_tokens", FWD_TOKENS).select(
        "num_finetuning_fwd_tokens",
        F.explode(F.array(*[F.lit(v) for v in BWD_LAYERS])).alias("num_bwd_layers"),
    )
    run = run_index(F.col("num_finetuning_fwd_tokens"), F.col("num_bwd_layers"))
    plain_runs = F.least(F.col("run_idx") - 1, F.lit(len(BWD_LAYERS)))
    ft_runs = F.col("run_idx") - 1 - plain_runs
    start = WARMUP_REQUESTS + plain_runs * REQUESTS_PER_RUN + ft_runs * (REQUESTS_PER_RUN + 1)
    return (
        cells.withColumn("run_idx", run)
        .withColumn("guid_lo", (F.lit(FIRST_GUID) + start).cast("bigint"))
        .withColumn("guid_hi", F.col("guid_lo") + REQUESTS_PER_RUN)
    )


def with_run(requests: DataFrame) -> DataFrame:
    """Attach run and grid cell to request rows by the id range of the run.

    The ranges are regular, so run and cell follow from the id by arithmetic;
    ids outside all ranges are left out.
    """
    offset = F.col("request_guid") - (FIRST_GUID + WARMUP_REQUESTS)
    plain = len(BWD_LAYERS) * REQUESTS_PER_RUN
    late = offset - plain
    run = F.when(offset < plain, F.floor(offset / REQUESTS_PER_RUN)).otherwise(
        F.when(late % (REQUESTS_PER_RUN + 1) < REQUESTS_PER_RUN, F.floor(late / (REQUESTS_PER_RUN + 1)) + len(BWD_LAYERS))
    )
    place = requests.where(offset >= 0).withColumn("_run", run.cast("int"))
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k)
    return (
        place.where(F.col("_run") < len(FWD_TOKENS) * len(BWD_LAYERS))
        .withColumn("num_finetuning_fwd_tokens", at(FWD_TOKENS, F.floor(F.col("_run") / len(BWD_LAYERS)).cast("int")))
        .withColumn("num_bwd_layers", at(BWD_LAYERS, F.col("_run") % len(BWD_LAYERS)))
        .withColumn("run_idx", F.col("_run") + 1)
        .drop("_run")
    )
