"""Request logs of a whole sweep to its comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loadscope.operators import serving, sweeps
from loadscope.session import write_table


def profile_report(log: DataFrame, results: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every sweep table from one pass over the log.

    The per-request marks are written once and feed all tables; they are smaller
    than the log by the number of tokens per request.
    """
    keys = sweeps.CONFIG
    marks = write_table(serving.request_marks(log, keys), "marks")
    requests = serving.request_latencies(marks, keys)
    report = {
        "latencies": serving.latencies(requests, keys),
        "throughput": sweeps.throughput(marks, keys),
        "mean_tpot": sweeps.mean_tpot(marks, keys),
        "tpot_curve": sweeps.tpot_curve(marks, keys),
    }
    if results is not None:
        report["versus_baseline"] = sweeps.versus_baseline(marks, results)
    return report
