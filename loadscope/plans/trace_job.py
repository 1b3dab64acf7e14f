"""Corpus to trace: sample, count, time-stamp and describe."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loadscope.functions.text import ChatTemplate, token_count
from loadscope.operators import arrivals, traces
from loadscope.session import write_table

TRACE_TYPES = ("offline", "poisson", "replay")


def schedule(
    spark, n: int, trace_type: str, rate: float, seed: int, *,
    arrival_log: DataFrame | None = None, on_short: str = "raise",
) -> DataFrame | None:
    """``ordinal, arrival_time`` of ``n`` requests; none for an offline trace."""
    if trace_type not in TRACE_TYPES:
        raise ValueError(f"trace type {trace_type!r} is not one of {', '.join(TRACE_TYPES)}")
    if trace_type == "offline":
        return None
    if trace_type == "poisson":
        return arrivals.poisson(spark.range(n).withColumnRenamed("id", "ordinal"), "ordinal", rate, seed)
    if arrival_log is None:
        raise ValueError("a replay needs an arrival log")
    return arrivals.replay(arrival_log, "t_us", rate, n, seed, on_short=on_short)


def build_trace(
    pairs: DataFrame, row_id: str, num_entries: int, max_length: int, seed: int, *,
    trace_type: str = "offline", arrival_rate: float = 0.0, arrival_log: DataFrame | None = None,
    on_short: str = "raise", template: ChatTemplate | None = None, no_prompt: bool = False,
    candidates: int | None = None, count_tokens=token_count,
) -> tuple[DataFrame, DataFrame]:
    """Entries and metadata of a trace over ``pairs`` (``row_id, prompt, response``).

    The sampled entries are written once: entries and metadata both read them, so
    the corpus is not counted again. A replay shorter than the trace raises, or does what
    ``on_short`` says, see :func:`arrivals.replay`.
    """
    times = schedule(
        pairs.sparkSession, num_entries, trace_type, arrival_rate, seed, arrival_log=arrival_log, on_short=on_short
    )
    prepared = traces.prepare_prompts(pairs, template=template, no_prompt=no_prompt)
    sampled = traces.sample_entries(
        prepared, row_id, num_entries, max_length, seed, candidates=candidates, count_tokens=count_tokens
    )
    entries = write_table(traces.with_arrivals(sampled, times, ends=on_short == "end"), "trace_entries")
    return entries, traces.metadata(entries, trace_type, arrival_rate)
