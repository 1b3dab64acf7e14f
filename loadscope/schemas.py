"""Explicit schemas of the inputs; nothing is inferred from file contents."""

from __future__ import annotations

from pyspark.sql import types as T

REQUEST_LOG = T.StructType(
    [
        T.StructField("request_guid", T.LongType()),
        T.StructField("is_warmup_request", T.IntegerType()),
        T.StructField("decoding_step_idx", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

STEP_LOG = T.StructType(
    [
        T.StructField("run_idx", T.IntegerType()),
        T.StructField("is_warmup_step", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("num_decoding_tokens", T.IntegerType()),
        T.StructField("num_prefilling_tokens", T.IntegerType()),
        T.StructField("num_finetuning_fwd_tokens", T.IntegerType()),
        T.StructField("num_finetuning_bwd_tokens", T.IntegerType()),
        T.StructField("num_bwd_layers", T.IntegerType()),
    ]
)

ARRIVAL_LOG = T.StructType([T.StructField("TIMESTAMP", T.TimestampType())])

BURST_LOG = T.StructType(
    [
        T.StructField("Timestamp", T.DoubleType()),
        T.StructField("Model", T.StringType()),
        T.StructField("Request tokens", T.LongType()),
        T.StructField("Response tokens", T.LongType()),
        T.StructField("Total tokens", T.LongType()),
        T.StructField("Log Type", T.StringType()),
    ]
)

TURN = T.StructType(
    [T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]
)
CONVERSATIONS = T.StructType([T.StructField("conversations", T.ArrayType(TURN))])

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
CHAT_CORPUS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("conversation", T.ArrayType(MESSAGE)),
    ]
)

TRACE_ENTRY = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("prompt_length", T.IntegerType()),
        T.StructField("response_length", T.IntegerType()),
        T.StructField("arrival_time", T.DoubleType()),
    ]
)

TRACE_METADATA = T.StructType(
    [
        T.StructField("num_warmup_requests", T.IntegerType()),
        T.StructField("avg_entries_per_partition", T.DoubleType()),
        T.StructField("max_prompt_length", T.IntegerType()),
        T.StructField("min_prompt_length", T.IntegerType()),
        T.StructField("avg_prompt_length", T.DoubleType()),
        T.StructField("max_response_length", T.IntegerType()),
        T.StructField("min_response_length", T.IntegerType()),
        T.StructField("avg_response_length", T.DoubleType()),
        T.StructField("avg_total_length", T.DoubleType()),
        T.StructField("max_total_length", T.IntegerType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("trace_type", T.StringType()),
        T.StructField("arrival_rate", T.DoubleType()),
    ]
)

TRACE_DOCUMENT = T.StructType(
    [
        T.StructField("entries", T.ArrayType(TRACE_ENTRY)),
        T.StructField("metadata", TRACE_METADATA),
    ]
)

SERVING_RESULT = T.StructType(
    [
        T.StructField("mean_tpot_ms", T.DoubleType()),
        T.StructField("output_throughput", T.DoubleType()),
    ]
)
