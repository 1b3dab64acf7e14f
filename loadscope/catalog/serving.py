"""Latency, throughput, goodput: from the request log and from client records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.catalog.registry import query, rounded
from loadscope.operators import client, serving

_PER_REQUEST = """
    select request_guid,
           (max(timestamp_us) filter (decoding_step_idx >= 0) - min(timestamp_us) filter (decoding_step_idx >= 0))
             / (count(*) filter (decoding_step_idx >= 0))::double / 1000 as tpot_ms,
           (min(timestamp_us) filter (decoding_step_idx = 0) - min(timestamp_us) filter (decoding_step_idx = -1))
             / 1000::double as ttft_ms,
           (min(timestamp_us) filter (decoding_step_idx = -1) - min(timestamp_us) filter (decoding_step_idx = -2))
             / 1000000::double as queueing_s
    from request_log where is_warmup_request = 0 and request_guid is not null
    group by request_guid"""


def _latency_sql(metric: str) -> str:
    return f"""
        select count({metric}) as requests, count(*) - count({metric}) as incomplete,
               round(avg({metric}), 3) as mean_{metric},
               round(quantile_cont({metric}, 0.5), 3) as median_{metric},
               round(quantile_cont({metric}, 0.99), 3) as p99_{metric}
        from ({_PER_REQUEST})"""


def _latency_query(name: str, metric: str) -> None:
    @query(name, _latency_sql(metric))
    def _run(i):
        return rounded(serving.latency(serving.per_request(i.request_log), metric), 3)


_latency_query("serving_tpot", "tpot_ms")
_latency_query("serving_ttft", "ttft_ms")
_latency_query("serving_queueing", "queueing_s")


@query(
    "serving_throughput",
    """
    select count(*) as output_tokens,
           round((max(timestamp_us) - min(timestamp_us)) / 1000000::double, 6) as duration_s,
           round(count(*) / ((max(timestamp_us) - min(timestamp_us)) / 1000000::double), 9) as throughput
    from request_log where is_warmup_request = 0 and decoding_step_idx >= 0""",
)
def serving_throughput(i):
    return rounded(rounded(serving.throughput(i.request_log), 6, "duration_s"), 9, "throughput")


_SLO = ["ttft:30000000", "tpot:45000000", "e2el:2500000000"]
_GOOD = """success and ttft_s <= 30000 and latency_s <= 2500000
           and (case when output_len > 1 then (latency_s - ttft_s) / (output_len - 1) else 0 end) <= 45000"""


@query(
    "serving_output_lengths",
    "select request_id, success, output_len::bigint as output_len from client_output",
)
def serving_output_lengths(i):
    return client.output_lengths(i.client_output).select("request_id", "success", "output_len")


@query(
    "serving_summary",
    """
    select round(max(dur_s), 6) as duration, count(*) filter (success) as completed,
           (sum(prompt_len) filter (success))::bigint as total_input_tokens,
           sum(output_len)::bigint as total_output_tokens,
           round(count(*) filter (success) / max(dur_s), 9) as request_throughput,
           round(sum(output_len) / max(dur_s), 9) as output_throughput,
           round((sum(prompt_len) filter (success) + sum(output_len)) / max(dur_s), 9) as total_token_throughput
    from client_output cross join dur""",
)
def serving_summary(i):
    out = client.summary(i.client_output, i.duration_s).drop("request_goodput")
    rates = ("request_throughput", "output_throughput", "total_token_throughput")
    return rounded(rounded(out, 6, "duration"), 9, *rates)


@query(
    "serving_goodput",
    f"""
    select count(*) filter (success) as completed,
           round(count(*) filter ({_GOOD}) / max(dur_s), 12) as request_goodput
    from client_output cross join dur""",
)
def serving_goodput(i):
    out = client.summary(i.client_output, i.duration_s, client.parse_slo(_SLO))
    return rounded(out.select("completed", "request_goodput"), 12)


def _block_sql(metric: str, value: str) -> str:
    return f"""
        round(coalesce(avg({value}) * 1000, 0), 3) as mean_{metric}_ms,
        round(coalesce(quantile_cont({value}, 0.5) * 1000, 0), 3) as median_{metric}_ms,
        round(coalesce(stddev_pop({value}) * 1000, 0), 3) as std_{metric}_ms,
        round(coalesce(quantile_cont({value}, 0.9) * 1000, 0), 3) as p90_{metric}_ms,
        round(coalesce(quantile_cont({value}, 0.99) * 1000, 0), 3) as p99_{metric}_ms"""


_RECORDS = """
    select case when success then ttft_s end as ttft, case when success then latency_s end as e2el,
           case when success and output_len > 1 then (latency_s - ttft_s) / (output_len - 1) end as tpot
    from client_output"""


@query(
    "serving_latency_stats",
    f"select {_block_sql('ttft', 'ttft')}, {_block_sql('tpot', 'tpot')}, {_block_sql('e2el', 'e2el')} from ({_RECORDS})",
)
def serving_latency_stats(i):
    return rounded(client.latency_blocks(i.client_output, percentiles=(90.0, 99.0)), 3)


@query("serving_itl_stats", f"select {_block_sql('itl', 'itl_s')} from token_gaps where success")
def serving_itl_stats(i):
    return rounded(client.gap_block(i.token_gaps, percentiles=(90.0, 99.0)), 3)


_CONFIG = {
    "date": "20240101-000000",
    "backend": "spark",
    "model_id": "org/model_a",
    "tokenizer_id": "org/model_a",
    "request_rate": "inf",
    "burstiness": 1.0,
    "completed": -1,
}
_METADATA = ["version=0.3.3", " tp = 1", "flags=a=b"]


def _run_record(i):
    metrics = client.summary(i.client_output, i.duration_s, client.parse_slo(_SLO))
    blocks = client.latency_blocks(i.client_output).select(F.struct("*").alias("b"))
    merged = metrics.withColumn("_b", blocks.scalar()).select("*", "_b.*").drop("_b")
    config = {**_CONFIG, "num_prompts": i.client_output.count(), "max_concurrency": 64}
    return client.run_record(config, merged, _METADATA)


RECORD_SQL = f"""
    select '20240101-000000' as date, 'spark' as backend, 'org/model_a' as model_id, 'org/model_a' as tokenizer_id,
           'inf' as request_rate, 1.0::double as burstiness, (select count(*) from client_output)::bigint as num_prompts, 64 as max_concurrency,
           '0.3.3' as version, '1' as tp, 'a' as flags,
           count(*) filter (success) as completed, sum(output_len)::bigint as total_output_tokens,
           round(count(*) filter ({_GOOD}) / max(dur_s), 12) as request_goodput
    from client_output cross join dur"""


def record_fields(record):
    """The configuration, metadata and some metrics of a run record."""
    meta = [F.col("metadata")[k].alias(k) for k in ("version", "tp", "flags")]
    config = ["date", "backend", "model_id", "tokenizer_id", "request_rate", "burstiness", "num_prompts", "max_concurrency"]
    return rounded(record.select(*config, *meta, "completed", "total_output_tokens", "request_goodput"), 12)


@query("serving_run_record", RECORD_SQL)
def serving_run_record(i):
    return record_fields(_run_record(i))


@query(
    "serving_metric_records",
    f"""
    with r as ({_RECORDS}),
    m as (select {{'median_ttft_ms': quantile_cont(ttft, 0.5), 'mean_ttft_ms': avg(ttft),
                   'std_ttft_ms': stddev_pop(ttft), 'p99_ttft_ms': quantile_cont(ttft, 0.99),
                   'median_tpot_ms': quantile_cont(tpot, 0.5), 'mean_tpot_ms': avg(tpot),
                   'std_tpot_ms': stddev_pop(tpot), 'p99_tpot_ms': quantile_cont(tpot, 0.99)}} as s from r),
    n as (select unnest(['median_ttft_ms', 'mean_ttft_ms', 'std_ttft_ms', 'p99_ttft_ms',
                         'median_tpot_ms', 'mean_tpot_ms', 'std_tpot_ms', 'p99_tpot_ms',
                         'median_itl_ms', 'mean_itl_ms', 'std_itl_ms', 'p99_itl_ms']) as metric)
    select n.metric,
           round(1000 * case n.metric
             when 'median_ttft_ms' then s.median_ttft_ms when 'mean_ttft_ms' then s.mean_ttft_ms
             when 'std_ttft_ms' then s.std_ttft_ms when 'p99_ttft_ms' then s.p99_ttft_ms
             when 'median_tpot_ms' then s.median_tpot_ms when 'mean_tpot_ms' then s.mean_tpot_ms
             when 'std_tpot_ms' then s.std_tpot_ms when 'p99_tpot_ms' then s.p99_tpot_ms end, 3) as value,
           'spark' as backend, (select count(*) from client_output where success)::varchar as completed
    from n cross join m""",
)
def serving_metric_records(i):
    records = client.metric_records(_run_record(i))
    return records.select(
        "metric",
        F.round(F.get("value", F.lit(0)), 3).alias("value"),
        F.col("extra_info")["backend"].alias("backend"),
        F.col("extra_info")["completed"].alias("completed"),
    )
