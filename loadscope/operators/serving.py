"""Latency and throughput from request-lifecycle logs.

The log has one row per mark: step -2 when a request is queued, -1 when it is
scheduled, 0 for its first token and 1, 2, ... for the tokens after it. One
aggregate per request feeds every latency metric; it combines on the map side,
so a request with any number of rows stays a handful of numbers per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.operators.quantiles import quantiles

# Lifecycle marks.
QUEUED, SCHEDULED, FIRST_TOKEN = -2, -1, 0

LATENCIES = ("tpot_ms", "ttft_ms", "queueing_s")


def measured_marks(log: DataFrame) -> DataFrame:
    return log.where(F.col("is_warmup_request") == 0)


def mark_aggregates() -> list[Column]:
    """What is kept of a request: its token count and the times of its marks."""
    idx, ts = F.col("decoding_step_idx"), F.col("timestamp_us")
    token = F.when(idx >= FIRST_TOKEN, ts)

    def mark(step: int) -> Column:
        return F.min(F.when(idx == step, ts))

    return [
        F.count_if(idx >= FIRST_TOKEN).alias("tokens"),
        F.min(token).alias("first_us"),
        F.max(token).alias("last_us"),
        mark(FIRST_TOKEN).alias("token_us"),
        mark(SCHEDULED).alias("scheduled_us"),
        mark(QUEUED).alias("queued_us"),
    ]


def request_marks(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The marks of every request, combined on the map side.

    Rows without a request id stay together as one group: they count as tokens
    for the throughput but are no request.
    """
    return measured_marks(log).groupBy(*(keys or []), "request_guid").agg(*mark_aggregates())


def request_latencies(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """TPOT, TTFT and queueing time per request; NULL where a mark is missing.

    TPOT divides the span of the token marks by their *number*, so a request with
    one token contributes 0.
    """
    span = F.col("last_us") - F.col("first_us")
    return marks.where(F.col("request_guid").isNotNull()).select(
        *(keys or []),
        "request_guid",
        "tokens",
        F.when(F.col("tokens") > 0, span / F.col("tokens") / F.lit(1e3)).alias("tpot_ms"),
        ((F.col("token_us") - F.col("scheduled_us")) / F.lit(1e3)).alias("ttft_ms"),
        ((F.col("scheduled_us") - F.col("queued_us")) / F.lit(1e6)).alias("queueing_s"),
    )


def per_request(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return request_latencies(request_marks(log, keys), keys)


def latencies(
    requests: DataFrame, keys: list[str] | None = None, metrics: tuple[str, ...] = LATENCIES
) -> DataFrame:
    """Mean, median and p99, one row per key and metric, with the incomplete requests counted."""
    stats = quantiles(
        requests, keys or [], list(metrics), {"median": 0.5, "p99": 0.99},
        extra={"incomplete": lambda c: F.count_if(F.col(c).isNull()), "mean": F.avg},
    )
    return stats.select(
        *(keys or []), "metric", F.col("n").alias("requests"), "incomplete", "mean", "median", "p99"
    )


def latency(requests: DataFrame, metric: str, keys: list[str] | None = None) -> DataFrame:
    """The same for one metric, named after it."""
    stats = latencies(requests, keys, (metric,))
    named = [F.col(c).alias(f"{c}_{metric}") for c in ("mean", "median", "p99")]
    return stats.select(*(keys or []), "requests", "incomplete", *named)


def marks_throughput(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Token marks per second over the span of the marks; NULL for a zero span."""
    span = (F.max("last_us") - F.min("first_us")) / F.lit(1e6)
    return (
        marks.groupBy(*(keys or []))
        .agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("output_tokens"), span.alias("duration_s"))
        .withColumn("throughput", F.try_divide(F.col("output_tokens"), F.col("duration_s")))
    )


def throughput(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same straight from the log: one map-side aggregate, nothing per request."""
    tokens = measured_marks(log).where(F.col("decoding_step_idx") >= FIRST_TOKEN)
    span = (F.max("timestamp_us") - F.min("timestamp_us")) / F.lit(1e6)
    return (
        tokens.groupBy(*(keys or []))
        .agg(F.count(F.lit(1)).alias("output_tokens"), span.alias("duration_s"))
        .withColumn("throughput", F.try_divide(F.col("output_tokens"), F.col("duration_s")))
    )
