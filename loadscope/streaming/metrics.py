"""Arrival rates and request latencies while the log is still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.operators import serving


def arrival_rates(
    arrivals: DataFrame, time: str, width: int = 5, late: str = "10 seconds", weight: str | None = None
) -> DataFrame:
    """Rows (or ``weight``) per second in event-time bins of ``width`` seconds.

    A bin is final once the watermark passes it. Unlike the batch histogram, bins
    without arrivals do not appear: the stream has no last bin to count up to.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    binned = arrivals.withWatermark(time, late).groupBy(F.window(time, f"{width} seconds").alias("bin"))
    return binned.agg((amount / width).alias("rate")).select("bin.start", "bin.end", "rate")


def request_latencies(log: DataFrame, quiet: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """TPOT, TTFT and queueing time of a request once it has been quiet for ``quiet``.

    The state of a request is its handful of marks, not its rows.
    """
    timed = serving.measured_marks(log).withColumn("_at", F.timestamp_micros("timestamp_us"))
    marks = (
        timed.withWatermark("_at", late)
        .groupBy(F.session_window("_at", quiet).alias("active"), "request_guid")
        .agg(*serving.mark_aggregates())
    )
    return serving.request_latencies(marks)
