"""Model and file names: normalisation, families, the result-file grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name grammar of the profiling logs and result files.
REQUEST_PREFIX = "inference_request_profiling"
STEP_PREFIX = "step_profiling"
PROFILE_NAME = (
    "%s_%s_%s_tensor_parallelism_%d_max_requests_per_batch_%d_max_tokens_per_batch_%d"
    "_num_kv_cache_slots_%d_qps_%s_num_warmup_requests_%d.csv"
)
PROFILE_NAME_BY_RATE = (
    "%s_%s_%s_tensor_parallelism_%d_max_requests_per_batch_%d_max_tokens_per_batch_%d"
    "_arrival_rate_%s_num_warmup_requests_%d.csv"
)


def normalise_model(name: Column) -> Column:
    return F.lower(F.translate(name, "/", "_"))


def model_family(name: Column) -> Column:
    """Folder of a model; the first rule that matches wins."""
    low = F.lower(name)
    return (
        F.when(low.contains("mistral"), "mistral")
        .when(low.contains("qwen") & low.contains("instruct"), "qwen_instruct")
        .when(low.contains("70b"), "70B")
        .otherwise("8B")
    )


def _alternatives(values: list[str]) -> str:
    """Known values as one regular-expression group, the longest first."""
    special = set(r".+*?()[]{}|^$\\")
    quoted = ["".join("\\" + c if c in special else c for c in v) for v in values]
    return "(" + "|".join(sorted(quoted, key=len, reverse=True)) + ")"


def profile_keys(path: Column, models: list[str]) -> dict[str, Column]:
    """Configuration encoded in a profiling file name.

    Data set and model may both contain ``_``; the model is matched against the
    known list so that whatever precedes it is the data set.
    """
    name = F.element_at(F.split(path, "/"), -1)
    lead = rf"^({REQUEST_PREFIX}|{STEP_PREFIX})_(.+?)_{_alternatives(models)}_tensor_parallelism_"

    def number(tag: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract(name, rf"_{tag}_([0-9.]+?)(?:_|\.csv)", 1), F.lit("")).cast(kind)

    def text(group: int) -> Column:
        return F.nullif(F.regexp_extract(name, lead, group), F.lit(""))

    return {
        "kind": text(1),
        "dataset": text(2),
        "model": text(3),
        "tp_degree": number("tensor_parallelism", "int"),
        "max_batch_size": number("max_requests_per_batch", "int"),
        "max_tokens_per_batch": number("max_tokens_per_batch", "int"),
        "num_kv_cache_slots": number("num_kv_cache_slots", "int"),
        "rate": F.coalesce(number("qps", "double"), number("arrival_rate", "double")),
        "num_warmup_requests": number("num_warmup_requests", "int"),
    }


def result_keys(path: Column, models: list[str]) -> dict[str, Column]:
    """Keys of ``results_{dataset}[_eager][_v1]_{model}[_bz_..][_part_{k}].json``."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = rf"^results_(.+?)(_eager)?(_v1)?_{_alternatives(models)}(?:_bz_.*?)?(?:_part_[0-9]+)?\.json$"
    return {
        "dataset": F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")),
        "eager": F.regexp_extract(name, pattern, 2) != "",
        "v1": F.when(F.regexp_extract(name, pattern, 3) != "", 1).otherwise(0),
        "model": F.nullif(F.regexp_extract(name, pattern, 4), F.lit("")),
    }


def result_name(dataset: Column, eager: Column, v1: Column, model: Column) -> Column:
    return F.concat(
        F.lit("results_"),
        dataset,
        F.when(eager, "_eager").otherwise(""),
        F.when(v1 == 1, "_v1").otherwise(""),
        F.lit("_"),
        normalise_model(model),
        F.lit(".json"),
    )
