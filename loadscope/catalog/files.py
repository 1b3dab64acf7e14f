"""Readers and writers: the tables go out as files and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope import schemas
from loadscope.catalog.inputs import sql_tokens
from loadscope.catalog.registry import query
from loadscope.catalog.traces import RATE, SAMPLE, SCHEDULE, _build, _poisson, entries_of
from loadscope.catalog.datasets import TEXT_CAP
from loadscope.catalog.serving import RECORD_SQL, _run_record, record_fields
from loadscope.catalog.sweeps import _RESULTS_SQL, _results
from loadscope.functions import names
from loadscope.operators import datasets, traces
from loadscope.session import shared_path
from loadscope.sources import corpora, files, logs

MODELS = ["org_model_a", "org_model_b"]


@query(
    "src_request_log",
    """
    select request_guid, is_warmup_request, decoding_step_idx, timestamp_us, dataset, 'org_' || model as model,
           max_batch_size, max_tokens_per_batch, 10 as num_warmup_requests
    from request_log""",
)
def src_request_log(i):
    folder = shared_path(i.spark, "request_csv")
    head = [F.lit(names.REQUEST_PREFIX), "dataset", F.concat(F.lit("org_"), "model"), F.lit(4), "max_batch_size", "max_tokens_per_batch"]
    name = F.format_string(names.PROFILE_NAME, *head, F.lit(240000), F.lit("0.000000"), F.lit(10))
    out = i.request_log.withColumnRenamed("timestamp_us", "timestamp").select(name.alias("file"), *schemas.REQUEST_LOG.names)
    files.write_named(out, "file", folder, "csv", header=True)
    keyed = logs.read_request_log(i.spark, f"{folder}/{names.REQUEST_PREFIX}_*.csv", MODELS)
    return keyed.select(
        "request_guid", "is_warmup_request", "decoding_step_idx", "timestamp_us", "dataset", "model",
        "max_batch_size", "max_tokens_per_batch", "num_warmup_requests",
    )


@query(
    "src_profiles",
    """
    select run_idx, is_warmup_step, timestamp_us, num_decoding_tokens, num_prefilling_tokens, num_finetuning_fwd_tokens,
           num_finetuning_bwd_tokens, num_bwd_layers, 'overhead_test' as dataset,
           case when run_idx % 2 = 0 then 'org_model_a' else 'org_model_b' end as model, 1 as tp_degree, 256 as max_batch_size,
           1024 as max_tokens_per_batch, 90000 as num_kv_cache_slots, 0.5::double as rate, 10 as num_warmup_requests
    from step_log""",
)
def src_profiles(i):
    folder = shared_path(i.spark, "step_csv")
    model = F.when(F.col("run_idx") % 2 == 0, "org_model_a").otherwise("org_model_b")
    head = [F.lit(names.STEP_PREFIX), F.lit("overhead_test"), model, F.lit(1), F.lit(256), F.lit(1024)]
    name = F.format_string(names.PROFILE_NAME, *head, F.lit(90000), F.lit("0.500000"), F.lit(10))
    out = i.step_log.withColumnRenamed("timestamp_us", "timestamp").select(name.alias("file"), *schemas.STEP_LOG.names)
    files.write_named(out, "file", folder, "csv", header=True)
    return logs.read_step_log(i.spark, f"{folder}/{names.STEP_PREFIX}_*.csv", MODELS).drop("step_id")


@query("src_arrival_log", "select t_us - min(t_us) over () as t_us from arrival_log")
def src_arrival_log(i):
    folder = shared_path(i.spark, "arrival_csv")
    stamp = F.date_format(F.timestamp_micros(F.col("t_us")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    i.arrival_log.select(stamp.alias("TIMESTAMP"), F.lit(1).alias("Other")).write.option("header", True).csv(folder)
    return logs.read_arrival_log(i.spark, folder)


@query("src_burst_log", "select timestamp_s from burst_log where model = 'ChatGPT'")
def src_burst_log(i):
    folder = shared_path(i.spark, "burst_csv")
    tokens = [F.lit(n).alias(c) for c, n in (("Request tokens", 1), ("Response tokens", 2), ("Total tokens", 3))]
    out = i.burst_log.select(F.col("timestamp_s").alias("Timestamp"), F.col("model").alias("Model"), *tokens, F.lit("Conversation log").alias("Log Type"))
    out.write.option("header", True).csv(folder)
    return logs.read_burst_log(i.spark, folder)


@query("src_results", f"select dataset, 'org_' || model as model, v1, eager, mean_tpot_ms, output_throughput from ({_RESULTS_SQL})")
def src_results(i):
    folder = shared_path(i.spark, "results")
    name = names.result_name(F.col("dataset"), F.col("eager"), F.col("v1"), F.concat(F.lit("Org/"), "model"))
    files.write_named(_results(i).select(name.alias("file"), *schemas.SERVING_RESULT.names), "file", folder, "json")
    return files.read_results(i.spark, f"{folder}/results_*.json", MODELS)


@query("src_conversations_json", "select prompt, response from exchange")
def src_conversations_json(i):
    folder = shared_path(i.spark, "conversations")
    # a conversation is one line of the file, so its turns are one array
    said = F.array_sort(F.collect_list(F.struct("turn", "from", "value")))
    nested = i.turns.groupBy("conv_id").agg(F.transform(said, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))
    corpora.to_lines(nested.select("conversations"), folder)
    return traces.first_exchange(corpora.read_conversations(i.spark, folder))


@query(
    "src_step_log",
    """
    select run_idx, is_warmup_step, timestamp_us, num_decoding_tokens, num_prefilling_tokens,
           num_finetuning_fwd_tokens, num_finetuning_bwd_tokens, num_bwd_layers from step_log""",
)
def src_step_log(i):
    folder = shared_path(i.spark, "step_csv")
    i.step_log.drop("step_id").withColumnRenamed("timestamp_us", "timestamp").write.option("header", True).csv(folder)
    return logs.read_step_log(i.spark, folder).drop("step_id")


def _trace(i):
    entries = traces.with_arrivals(_build(i), _poisson(i, entries_of(i), RATE, 42))
    return entries, traces.metadata(entries, "poisson", RATE)


@query(
    "trace_export",
    f"""
    select s.ordinal, s.prompt, s.response, s.p::int as prompt_length, s.r::int as response_length, a.arrival_time
    from ({SAMPLE}) s join ({SCHEDULE}) a on a.ordinal = s.ordinal""",
)
def trace_export(i):
    folder = shared_path(i.spark, "trace")
    files.write_trace(*_trace(i), folder)
    schema = "ordinal bigint, prompt string, response string, prompt_length int, response_length int, arrival_time double"
    return i.spark.read.schema(schema).json(f"{folder}/entries")


@query(
    "trace_reload_head",
    f"select ordinal, prompt, p::int as prompt_len, r::int as expected_output_len from ({SAMPLE}) where ordinal < 20",
)
def trace_reload_head(i):
    folder = shared_path(i.spark, "trace_head")
    files.write_trace(*_trace(i), folder)
    return files.read_trace(i.spark, folder, 20)


@query("dataset_text_export", f"select text from documents where {sql_tokens('text')} < 512")
def dataset_text_export(i):
    folder = shared_path(i.spark, "texts")
    capped = datasets.length_cap(datasets.with_token_count(i.documents), 512)
    files.write_texts(capped, folder)
    return files.read_texts(i.spark, folder)


@query("dataset_export", f"select doc_id, lang, source, n_chars from documents where {sql_tokens('text')} < {TEXT_CAP}")
def dataset_export(i):
    folder = shared_path(i.spark, "projection")
    capped = datasets.length_cap(datasets.with_token_count(i.table("documents")), TEXT_CAP)
    files.write_rows(datasets.instruct_projection(capped), folder)
    return i.spark.read.schema("doc_id bigint, lang string, source string, n_chars bigint").json(folder)


@query("run_record_export", RECORD_SQL)
def run_record_export(i):
    folder = shared_path(i.spark, "record")
    record = _run_record(i)
    files.write_record(record, folder)
    return record_fields(i.spark.read.schema(record.drop(*files.BULKY_FIELDS).schema).json(folder))
