"""Step-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.catalog.registry import query, rounded
from loadscope.operators import steps


@query(
    "step_ft_throughput",
    """
    select sum(num_finetuning_fwd_tokens)::bigint as fwd_tokens, sum(num_finetuning_bwd_tokens)::bigint as bwd_tokens,
           round((max(timestamp_us) - min(timestamp_us)) / 1000000::double, 6) as duration_s,
           sum(num_finetuning_fwd_tokens) = sum(num_finetuning_bwd_tokens) as is_balanced,
           round(sum(num_finetuning_fwd_tokens) / ((max(timestamp_us) - min(timestamp_us)) / 1000000::double), 9) as throughput
    from ft_log
    where is_warmup_step = 0 and run_idx > 0 and (num_finetuning_fwd_tokens > 0 or num_finetuning_bwd_tokens > 0)""",
)
def step_ft_throughput(i):
    return rounded(rounded(steps.ft_throughput(i.ft_log, strict=True), 6, "duration_s"), 9, "throughput")


@query(
    "step_ft_balance",
    """
    select sum(num_finetuning_fwd_tokens)::bigint as fwd_tokens, sum(num_finetuning_bwd_tokens)::bigint as bwd_tokens,
           sum(num_finetuning_fwd_tokens) = sum(num_finetuning_bwd_tokens) as is_balanced
    from step_log
    where is_warmup_step = 0 and run_idx > 0 and (num_finetuning_fwd_tokens > 0 or num_finetuning_bwd_tokens > 0)""",
)
def step_ft_balance(i):
    return steps.ft_throughput(i.step_log).select("fwd_tokens", "bwd_tokens", "is_balanced")


_SERIES = """
    select *, num_decoding_tokens / nullif(time_diff_sec, 0) as throughput,
           (timestamp_us - min(timestamp_us) over ()) / 1000000::double as relative_time
    from (select step_id, timestamp_us, num_decoding_tokens,
                 (timestamp_us - lag(timestamp_us) over (order by timestamp_us, step_id)) / 1000000::double as time_diff_sec
          from step_log where run_idx <> 0 and is_warmup_step <> 1 and num_decoding_tokens <> 0)
    where time_diff_sec is not null"""


@query(
    "step_throughput_series",
    f"""
    select step_id, num_decoding_tokens, round(time_diff_sec, 6) as time_diff_sec,
           round(throughput, 6) as throughput, round(relative_time, 6) as relative_time
    from ({_SERIES})""",
)
def step_throughput_series(i):
    log = i.step_log.select(
        "step_id", "timestamp_us", "run_idx", "is_warmup_step", "num_decoding_tokens"
    )
    series = steps.throughput_series(log)
    return rounded(
        series.select("step_id", "num_decoding_tokens", "time_diff_sec", "throughput", "relative_time"), 6
    )


@query(
    "step_throughput_describe",
    f"""
    select count(throughput) as "count", round(avg(throughput), 6) as mean, round(stddev_samp(throughput), 6) as std,
           round(min(throughput), 6) as "min", round(quantile_cont(throughput, 0.25), 6) as p25,
           round(quantile_cont(throughput, 0.5), 6) as p50, round(quantile_cont(throughput, 0.75), 6) as p75,
           round(max(throughput), 6) as "max"
    from ({_SERIES})""",
)
def step_throughput_describe(i):
    log = i.step_log.select(
        "step_id", "timestamp_us", "run_idx", "is_warmup_step", "num_decoding_tokens"
    )
    return rounded(steps.describe_throughput(steps.throughput_series(log)), 6)


_TIMES = """
    select *, (timestamp_us - lag(timestamp_us) over (partition by run_idx order by timestamp_us, step_id)) / 1000::double as step_time_ms
    from step_log where run_idx >= 1 and is_warmup_step <> 1"""


@query("step_time_by_run", f"select step_id, run_idx, round(step_time_ms, 3) as step_time_ms from ({_TIMES})")
def step_time_by_run(i):
    log = i.step_log.select("step_id", "timestamp_us", "run_idx", "is_warmup_step")
    return rounded(steps.step_times(log).select("step_id", "run_idx", "step_time_ms"), 3)


def _overhead_sql(column: str, values: tuple[int, ...], where: str) -> str:
    return f"""
    with t as ({_TIMES}),
    r as (select run_idx, {column} as x, avg(step_time_ms) as m from t
          where num_decoding_tokens = 256 and num_prefilling_tokens = 0 and {where} group by 1, 2)
    select g.x::int as {column}, round(avg(r.m), 3) as step_time_ms, count(r.m) as runs
    from (select unnest({list(values)}) as x) g left join r on r.x = g.x group by g.x"""


@query(
    "step_overhead_fwd",
    _overhead_sql("num_finetuning_fwd_tokens", (*steps.FWD_TOKENS, 8192), "num_finetuning_bwd_tokens = 0"),
)
def step_overhead_fwd(i):
    return rounded(steps.fwd_overhead(steps.step_times(i.step_log), (*steps.FWD_TOKENS, 8192)), 3)


@query(
    "step_overhead_bwd",
    _overhead_sql(
        "num_bwd_layers", steps.BWD_LAYERS, "num_finetuning_fwd_tokens = 0 and num_finetuning_bwd_tokens = 4096"
    ),
)
def step_overhead_bwd(i):
    return rounded(steps.bwd_overhead(steps.step_times(i.step_log)), 3)


@query(
    "step_run_index",
    """
    select step_id,
           case when run_idx = 0 then null
                else 1 + list_position([0, 1024, 2048, 3072, 4096], fwd) * 5 - 5
                       + list_position([0, 8, 16, 24, 32], layers) - 1 end::int as run_index
    from (select step_id, run_idx, (run_idx - 1) // 5 * 1024 as fwd, (run_idx - 1) % 5 * 8 as layers from step_log)""",
)
def step_run_index(i):
    cell = i.step_log.select(
        "step_id",
        (F.floor((F.col("run_idx") - 1) / 5) * 1024).cast("int").alias("fwd"),
        ((F.col("run_idx") - 1) % 5 * 8).cast("int").alias("layers"),
    )
    return cell.select("step_id", steps.run_index(F.col("fwd"), F.col("layers"), strict=False).alias("run_index"))


@query(
    "step_guid_ranges",
    """
    with f as (select unnest([0, 1024, 2048, 3072, 4096]) as fwd, unnest([0, 1, 2, 3, 4]) as fi),
    b as (select unnest([0, 8, 16, 24, 32]) as layers, unnest([0, 1, 2, 3, 4]) as bi),
    g as (select fwd, layers, 1 + fi * 5 + bi as run_idx,
                 1000000 + 11 + case when fi = 0 then 8 * bi else 40 + ((fi - 1) * 5 + bi) * 9 end as lo
          from f, b)
    select g.run_idx::int as run_idx, g.fwd::int as num_finetuning_fwd_tokens, g.layers::int as num_bwd_layers,
           count(*) as marks, count(distinct request_guid) as requests
    from request_log r join g on r.request_guid >= g.lo and r.request_guid < g.lo + 8
    group by 1, 2, 3""",
)
def step_guid_ranges(i):
    keys = ["run_idx", "num_finetuning_fwd_tokens", "num_bwd_layers"]
    per_request = i.request_log.groupBy("request_guid").agg(F.count(F.lit(1)).alias("marks"))
    return steps.with_run(per_request).groupBy(*keys).agg(
        F.sum("marks").alias("marks"), F.count(F.lit(1)).alias("requests")
    )
