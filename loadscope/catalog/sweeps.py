"""Grids, file names and comparisons across configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.catalog.registry import query, rounded
from loadscope.catalog.serving import _PER_REQUEST
from loadscope.functions import names
from loadscope.operators import serving, sweeps
from loadscope.plans import profile_job

MODELS = ["org_model_a", "org_model_b"]
_CONFIG = "dataset, model, max_batch_size, max_tokens_per_batch"
_BY_CONFIG = _PER_REQUEST.replace("select request_guid,", f"select {_CONFIG}, request_guid,").replace(
    "group by request_guid", f"group by {_CONFIG}, request_guid"
)
_RATES = f"""
    select {_CONFIG}, count(*) / ((max(timestamp_us) - min(timestamp_us)) / 1000000::double) as throughput
    from request_log where is_warmup_request = 0 and decoding_step_idx >= 0 group by {_CONFIG}"""


def _marks(i):
    return serving.request_marks(i.request_log, sweeps.CONFIG)


def _profile_paths(i):
    """One file name per observed configuration; one is of the older form."""
    cells = i.request_log.select(*sweeps.CONFIG).distinct()
    dataset = F.when(F.col("dataset") == "wildchat", "overhead_test").otherwise(F.col("dataset"))
    head = [F.lit(names.REQUEST_PREFIX), dataset, F.concat(F.lit("org_"), F.col("model")), F.lit(4)]
    sizes = [F.col("max_batch_size"), F.col("max_tokens_per_batch")]
    current = F.format_string(names.PROFILE_NAME, *head, *sizes, F.lit(240000), F.lit("0.000000"), F.lit(10))
    older = F.format_string(names.PROFILE_NAME_BY_RATE, *head, *sizes, F.lit("0.200000"), F.lit(10))
    path = F.when(F.col("max_tokens_per_batch") == 1024, older).otherwise(current)
    return cells.select(F.concat(F.lit("profiling/"), path).alias("path"))


@query(
    "sweep_file_keys",
    """
    select 'profiling/inference_request_profiling_' || d || '_org_' || model || '_tensor_parallelism_4_max_requests_per_batch_'
             || max_batch_size || '_max_tokens_per_batch_' || max_tokens_per_batch
             || case when max_tokens_per_batch = 1024 then '_arrival_rate_0.200000'
                     else '_num_kv_cache_slots_240000_qps_0.000000' end || '_num_warmup_requests_10.csv' as path,
           'inference_request_profiling' as kind, d as dataset, 'org_' || model as model, 4 as tp_degree,
           max_batch_size, max_tokens_per_batch,
           case when max_tokens_per_batch <> 1024 then 240000 end as num_kv_cache_slots,
           case when max_tokens_per_batch = 1024 then 0.2 else 0 end::double as rate, 10 as num_warmup_requests
    from (select distinct dataset, model, max_batch_size, max_tokens_per_batch,
                 case when dataset = 'wildchat' then 'overhead_test' else dataset end as d from request_log)""",
)
def sweep_file_keys(i):
    paths = _profile_paths(i)
    return paths.withColumns(names.profile_keys(F.col("path"), MODELS))


_FAMILY_NAMES = (
    "mistralai/Mistral-Small-24B-Instruct", "Qwen/Qwen2.5-32B-Instruct", "Qwen/Qwen2.5-32B",
    "meta-llama/Llama-3.1-70B-Instruct", "meta-llama/Llama-3.1-8B-Instruct", "org/Qwen-Mistral-70B-INSTRUCT",
)


@query(
    "sweep_model_family",
    f"""
    select p_partkey, name, replace(lower(name), '/', '_') as normalised,
           case when lower(name) like '%mistral%' then 'mistral'
                when lower(name) like '%qwen%' and lower(name) like '%instruct%' then 'qwen_instruct'
                when lower(name) like '%70b%' then '70B' else '8B' end as family
    from (select p_partkey, {list(_FAMILY_NAMES)}[1 + (p_partkey % 6)::int] || '-' || p_size as name from part)""",
)
def sweep_model_family(i):
    pool = F.array(*[F.lit(n) for n in _FAMILY_NAMES])
    name = F.concat(F.get(pool, (F.col("p_partkey") % 6).cast("int")), F.lit("-"), F.col("p_size").cast("string"))
    named = i.table("part").select("p_partkey", name.alias("name"))
    return named.select(
        "*", names.normalise_model(F.col("name")).alias("normalised"), names.model_family(F.col("name")).alias("family")
    )


_GRID_SQL = """
    select d.dataset, m.model, b.max_batch_size, t.max_tokens_per_batch
    from (select distinct dataset from request_log) d, (select distinct model from request_log) m,
         (select distinct max_batch_size from request_log) b, (select distinct max_tokens_per_batch from request_log) t"""


@query("sweep_grid", f"select * from ({_GRID_SQL}) where max_tokens_per_batch >= max_batch_size")
def sweep_grid(i):
    return sweeps.feasible(sweeps.observed_grid(i.request_log, sweeps.CONFIG))


@query(
    "sweep_missing_cells",
    f"""
    select g.* from (select * from ({_GRID_SQL}) union all select distinct dataset, model, 512 as max_batch_size, max_tokens_per_batch from ({_GRID_SQL})) g
    where not exists (select 1 from request_log r where r.dataset = g.dataset and r.model = g.model
                      and r.max_batch_size = g.max_batch_size and r.max_tokens_per_batch = g.max_tokens_per_batch)""",
)
def sweep_missing_cells(i):
    cells = sweeps.observed_grid(i.request_log, sweeps.CONFIG)
    absent = cells.withColumn("max_batch_size", F.lit(512)).distinct()
    return sweeps.missing_cells(cells.unionByName(absent), i.request_log, sweeps.CONFIG)


@query(
    "sweep_task_index",
    """
    select event_id, (t // 35)::int as trace, (t % 35 // 5)::int as batch_size, (t % 5)::int as tokens,
           (u // 12)::int as trace24, (u % 12 // 6)::int as v1, (u % 6 // 3)::int as eager, (u % 3)::int as model
    from (select event_id, event_id % 70 as t, event_id % 24 as u from events)""",
)
def sweep_task_index(i):
    first = sweeps.task_index(F.col("event_id") % 70, {"trace": 2, "batch_size": 7, "tokens": 5})
    second = sweeps.task_index(F.col("event_id") % 24, {"trace24": 2, "v1": 2, "eager": 2, "model": 3})
    return i.table("events").select("event_id", *[c.alias(a) for a, c in {**first, **second}.items()])


@query(
    "sweep_config_zip",
    """
    with c as (select unnest(['model_a', 'model_b']) as model, unnest([1, 2]) as tp_degree,
                      unnest([40000, 100000]) as memory, unnest([5.0, 3.5]::double[]) as qps,
                      unnest([[4, 16, 32], [4, 20, 40]]) as layers)
    select c.model, tp_degree, memory, qps, unnest(layers) as num_bwd_layers, n.requests
    from c join (select model, count(distinct request_guid) as requests from request_log group by 1) n on n.model = c.model""",
)
def sweep_config_zip(i):
    config = sweeps.zip_config(
        i.spark,
        {
            "model": ["model_a", "model_b"],
            "tp_degree": [1, 2],
            "memory": [40000, 100000],
            "qps": [5.0, 3.5],
            "num_bwd_layers": [[4, 16, 32], [4, 20, 40]],
        },
        explode="num_bwd_layers",
    )
    requests = i.request_log.groupBy("model", "request_guid").agg(F.lit(1).alias("one")).groupBy("model")
    return requests.agg(F.count("one").alias("requests")).join(F.broadcast(config), "model")  # six literal rows


@query(
    "sweep_result_path",
    """
    select dataset, model, v1, eager, 'results_' || dataset || case when eager then '_eager' else '' end
             || case when v1 = 1 then '_v1' else '' end || '_' || replace(lower('Org/' || model), '/', '_') || '.json' as path
    from (select distinct dataset, model from request_log), (select unnest([0, 1]) as v1), (select unnest([true, false]) as eager)""",
)
def sweep_result_path(i):
    cells = _result_grid(i)
    model = F.concat(F.lit("Org/"), F.col("model"))
    return cells.withColumn("path", names.result_name(F.col("dataset"), F.col("eager"), F.col("v1"), model))


def _result_grid(i):
    shown = i.request_log.select("dataset", "model").distinct()
    cells = shown.withColumn("v1", F.explode(F.array(F.lit(0), F.lit(1))))
    return cells.withColumn("eager", F.explode(F.array(F.lit(True), F.lit(False))))


def _results(i):
    """Competitor results: one per cell, none for one data set of one model."""
    counts = i.request_log.groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.withColumn("v1", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = cells.withColumn("eager", F.explode(F.array(F.lit(True), F.lit(False))))
    return cells.where("not (dataset = 'wildchat' and model = 'model_b')").select(
        "dataset", "model", "v1", "eager",
        (F.col("n") / F.lit(10.0) + F.col("v1")).alias("mean_tpot_ms"),
        (F.col("n") / F.lit(100.0)).alias("output_throughput"),
    )


_RESULTS_SQL = """
    select dataset, model, v1, eager, n / 10::double + v1 as mean_tpot_ms, n / 100::double as output_throughput
    from (select dataset, model, count(*) as n from request_log group by 1, 2),
         (select unnest([0, 1]) as v1), (select unnest([true, false]) as eager)
    where not (dataset = 'wildchat' and model = 'model_b')"""


@query(
    "sweep_baseline_lookup",
    f"""
    select g.dataset, g.model, g.v1, g.eager, r.mean_tpot_ms, r.output_throughput
    from (select distinct dataset, model, v1, eager from request_log, (select unnest([0, 1]) as v1), (select unnest([true, false]) as eager)) g
    left join ({_RESULTS_SQL}) r on r.dataset = g.dataset and r.model = g.model and r.v1 = g.v1 and r.eager = g.eager""",
)
def sweep_baseline_lookup(i):
    return sweeps.lookup(_results(i), _result_grid(i), strict=False)


@query("sweep_throughput", f"select {_CONFIG}, round(throughput, 9) as throughput from ({_RATES})")
def sweep_throughput(i):
    return rounded(sweeps.throughput(_marks(i)), 9)


@query("sweep_tpot", f"select {_CONFIG}, round(avg(tpot_ms), 3) as mean_tpot_ms from ({_BY_CONFIG}) group by {_CONFIG}")
def sweep_tpot(i):
    return rounded(sweeps.mean_tpot(_marks(i)), 3)


@query(
    "sweep_vs_baseline",
    f"""
    with own as (select r.*, t.mean_tpot_ms from ({_RATES}) r
                 join (select {_CONFIG}, avg(tpot_ms) as mean_tpot_ms from ({_BY_CONFIG}) group by {_CONFIG}) t
                 using ({_CONFIG}))
    select dataset, model, 'batch ' || max_batch_size as series,
           (row_number() over (partition by dataset, model, max_batch_size order by max_tokens_per_batch))::int as position,
           max_tokens_per_batch, round(mean_tpot_ms, 3) as mean_tpot_ms, round(throughput, 9) as throughput
    from own
    union all
    select b.dataset, b.model, 'baseline' || case when v1 = 1 then ' v1' else '' end || case when eager then ' (eager)' else '' end,
           1, null, round(b.mean_tpot_ms, 3), round(b.output_throughput, 9)
    from ({_RESULTS_SQL}) b join (select distinct dataset, model from own) o on o.dataset = b.dataset and o.model = b.model""",
)
def sweep_vs_baseline(i):
    return rounded(rounded(sweeps.versus_baseline(_marks(i), _results(i)), 3, "mean_tpot_ms"), 9, "throughput")


@query(
    "sweep_tpot_curve",
    f"""
    select {_CONFIG}, round(mean_tpot_ms, 3) as mean_tpot_ms, round(p99_tpot_ms, 3) as p99_tpot_ms, round(throughput, 9) as throughput,
           (row_number() over (partition by dataset, model order by throughput, max_batch_size, max_tokens_per_batch))::int as position
    from ({_RATES}) join (select {_CONFIG}, avg(tpot_ms) as mean_tpot_ms, quantile_cont(tpot_ms, 0.99) as p99_tpot_ms
                          from ({_BY_CONFIG}) group by {_CONFIG}) using ({_CONFIG})""",
)
def sweep_tpot_curve(i):
    curve = sweeps.tpot_curve(_marks(i))
    return rounded(rounded(curve, 3, "mean_tpot_ms", "p99_tpot_ms"), 9, "throughput")


_BY_TOKENS = ["dataset", "model", "max_tokens_per_batch"]


def _latency_by_sql(metric: str) -> str:
    return f"""
        select dataset, model, max_tokens_per_batch, round(avg({metric}), 3) as mean_{metric},
               round(quantile_cont({metric}, 0.99), 3) as p99_{metric}
        from ({_BY_CONFIG}) group by dataset, model, max_tokens_per_batch"""


@query("sweep_ttft", _latency_by_sql("ttft_ms"))
def sweep_ttft(i):
    marks = serving.request_marks(i.request_log, _BY_TOKENS)
    return rounded(sweeps.latency_by(marks, "ttft_ms", _BY_TOKENS), 3)


@query("sweep_queueing", _latency_by_sql("queueing_s"))
def sweep_queueing(i):
    marks = serving.request_marks(i.request_log, _BY_TOKENS)
    return rounded(sweeps.latency_by(marks, "queueing_s", _BY_TOKENS), 3)


def _long_sql(metric: str) -> str:
    return f"""
        select {_CONFIG}, '{metric}' as metric, count({metric}) as requests, count(*) - count({metric}) as incomplete,
               round(avg({metric}), 3) as mean, round(quantile_cont({metric}, 0.5), 3) as median,
               round(quantile_cont({metric}, 0.99), 3) as p99
        from ({_BY_CONFIG}) group by {_CONFIG}"""


@query("sweep_latencies", " union all ".join(_long_sql(m) for m in serving.LATENCIES))
def sweep_latencies(i):
    return rounded(profile_job.profile_report(i.request_log)["latencies"], 3)
