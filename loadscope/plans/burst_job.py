"""Burst log to trace: slice, rescale, attach prompts, and the rates before and after."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.operators import arrivals, traces
from loadscope.session import write_table


@dataclass(frozen=True)
class BurstTrace:
    entries: DataFrame
    metadata: DataFrame
    rate_before: DataFrame
    rate_after: DataFrame
    tokens_before: DataFrame
    tokens_after: DataFrame


def build_burst_trace(
    log: DataFrame, row_id: str, pairs: DataFrame, pair_id: str, *, duration_s: float, rate: float,
    max_length: int, seed: int, strict: bool = True,
) -> BurstTrace:
    """A trace whose arrivals follow a slice of ``log`` (``row_id, timestamp_s``) at ``rate`` per second."""
    cut = write_table(arrivals.time_slice(log, "timestamp_s", duration_s, seed), "slice")
    scaled = write_table(arrivals.scale_rate(cut, row_id, "timestamp_s", rate), "scaled")  # numbering reads it several times

    def attach(rows: DataFrame, order: list[str]) -> DataFrame:
        joined = traces.attach_pairs(rows, pairs, pair_id, max_length, seed, order=order, strict=strict)
        return write_table(joined, "burst")

    before = attach(cut, ["timestamp_s", row_id])
    after = attach(scaled, ["timestamp_s", row_id, "copy"])
    entries = after.select(
        "ordinal", "prompt", "response", "prompt_length", "response_length",
        F.round("timestamp_s", 3).alias("arrival_time"),
    )
    histogram = arrivals.rate_histogram
    return BurstTrace(
        entries=entries,
        metadata=traces.metadata(entries, "burstgpt", rate),
        rate_before=histogram(before, "timestamp_s"),
        rate_after=histogram(after, "timestamp_s"),
        tokens_before=histogram(before, "timestamp_s", weight="response_length"),
        tokens_after=histogram(after, "timestamp_s", weight="response_length"),
    )
