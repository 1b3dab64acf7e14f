"""Client records of a run to its result row and metric records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.operators import client


def serving_report(
    records: DataFrame, duration: Column | float, *, token_gaps: DataFrame | None = None,
    slo: list[str] | None = None, percentiles: tuple[float, ...] = (99.0,),
    config: dict | None = None, metadata: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The run record (one row) and its metric records."""
    metrics = client.summary(records, duration, client.parse_slo(slo))
    blocks = [client.latency_blocks(records, percentiles=percentiles)]
    if token_gaps is not None:
        blocks.append(client.gap_block(token_gaps, percentiles))
    for n, block in enumerate(blocks):
        name = f"_b{n}"
        metrics = metrics.withColumn(name, block.select(F.struct("*")).scalar()).select("*", f"{name}.*").drop(name)
    record = client.run_record(config or {}, metrics, metadata)
    return record, client.metric_records(record)
