"""Metrics from client-side records: one row per request, joined by request id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import token_count
from loadscope.operators.quantiles import quantiles

# The metrics a service-level objective may name, in milliseconds.
SLO_METRICS = ("ttft", "tpot", "e2el")

# Metrics written as records; everything else is extra information.
RECORD_METRICS = (
    "median_ttft_ms", "mean_ttft_ms", "std_ttft_ms", "p99_ttft_ms",
    "mean_tpot_ms", "median_tpot_ms", "std_tpot_ms", "p99_tpot_ms",
    "median_itl_ms", "mean_itl_ms", "std_itl_ms", "p99_itl_ms",
)
BULKY_FIELDS = ("input_lens", "output_lens", "ttfts", "itls", "generated_texts", "errors")


def parse_slo(pairs: list[str] | None) -> dict[str, float]:
    """``["ttft:100", ...]`` to milliseconds per metric; the last duplicate wins."""
    slo: dict[str, float] = {}
    for pair in pairs or []:
        name, found, value = pair.partition(":")
        try:
            if not found or ":" in value:
                raise ValueError(pair)
            slo[name] = float(value)
        except ValueError as err:
            raise ValueError(f"objective {pair!r} is not KEY:VALUE with a number of milliseconds") from err
    for name, value in slo.items():
        if name not in SLO_METRICS:
            raise ValueError(f"unknown objective {name!r}; use one of {', '.join(SLO_METRICS)}")
        if value < 0:
            raise ValueError(f"objective {name!r} is negative: {value}")
    return slo


def percentile_label(p: float) -> str:
    """99.0 -> ``p99``, 99.9 -> ``p99.9``."""
    return f"p{int(p)}" if int(p) == p else f"p{p}"


def output_lengths(records: DataFrame, count_tokens=token_count) -> DataFrame:
    """Reported output length, else counted from the text; 0 for a failed request."""
    counted = F.coalesce(F.col("output_tokens"), count_tokens(F.col("generated_text")))
    return records.withColumn(
        "output_len", F.when(F.col("success"), counted).otherwise(0).cast("bigint")
    )


def with_latencies(records: DataFrame) -> DataFrame:
    """Per-request seconds. ``tpot_s`` is NULL for a one-token reply, ``tpot0_s`` is 0 there."""
    ok = F.col("success")
    tpot = (F.col("latency_s") - F.col("ttft_s")) / (F.col("output_len") - 1)
    per_token = F.when(ok & (F.col("output_len") > 1), tpot)
    return records.select(
        "*",
        F.when(ok, F.col("ttft_s")).alias("ttft"),
        F.when(ok, F.col("latency_s")).alias("e2el"),
        per_token.alias("tpot"),
        F.when(ok, F.coalesce(per_token, F.lit(0.0))).alias("tpot0"),
    )


def good(slo: dict[str, float]) -> Column:
    """True for a success that meets every objective; without objectives nothing counts."""
    if not slo:
        return F.lit(False)
    meets = F.col("success")
    for name, limit_ms in slo.items():
        meets = meets & (F.col("tpot0" if name == "tpot" else name) <= F.lit(limit_ms / 1000))
    return meets


def summary(records: DataFrame, duration: Column | float, slo: dict[str, float] | None = None) -> DataFrame:
    """Counts and rates over a run of ``duration`` seconds, in one aggregate."""
    rows = with_latencies(output_lengths(records))
    totals = rows.agg(
        F.count_if("success").alias("completed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("prompt_len"))), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_len"), F.lit(0)).alias("total_output_tokens"),
        F.count_if(good(slo or {})).alias("good"),
    )
    seconds = duration if isinstance(duration, Column) else F.lit(float(duration))
    timed = totals.withColumn("duration", seconds)

    def rate(amount: Column) -> Column:
        return F.try_divide(amount, F.col("duration"))

    return timed.select(
        "duration",
        "completed",
        "total_input_tokens",
        "total_output_tokens",
        rate(F.col("completed")).alias("request_throughput"),
        rate(F.col("good")).alias("request_goodput"),
        rate(F.col("total_output_tokens")).alias("output_throughput"),
        rate(F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_token_throughput"),
    )


def _block(rows: DataFrame, columns: dict[str, str], percentiles: tuple[float, ...]) -> DataFrame:
    """One wide row in ms: mean, median, population deviation and percentiles of columns in seconds."""
    probs = {"median": 0.5, **{percentile_label(p): p / 100 for p in percentiles}}
    stats = quantiles(rows, [], list(columns), probs, extra={"mean": F.avg, "std": F.stddev_pop})
    names = ["mean", "median", "std", *[n for n in probs if n != "median"]]

    def value(column: str, name: str) -> Column:
        return F.max(F.when(F.col("metric") == column, F.col(f"`{name}`"))) * 1000

    return stats.agg(
        *[
            F.coalesce(value(column, name), F.lit(0.0)).alias(f"{name}_{label}_ms")
            for column, label in columns.items()
            for name in names
        ]
    )


def latency_blocks(
    records: DataFrame, metrics: tuple[str, ...] = ("ttft", "tpot", "e2el"),
    percentiles: tuple[float, ...] = (99.0,),
) -> DataFrame:
    """One wide row of latency statistics in ms; 0 where no request qualifies."""
    return _block(with_latencies(output_lengths(records)), {m: m for m in metrics}, percentiles)


def gaps(records: DataFrame) -> DataFrame:
    """Inter-token gaps of records that carry them as an array, one row per gap."""
    return records.select("request_id", "success", F.explode("itl_s").alias("itl_s"))


def gap_block(token_gaps: DataFrame, percentiles: tuple[float, ...] = (99.0,)) -> DataFrame:
    """Inter-token latency statistics over the gaps of all successful requests."""
    return _block(token_gaps.where("success"), {"itl_s": "itl"}, percentiles)


def metadata_map(items: list[str]) -> Column:
    """``KEY=VALUE`` items as a map; text after a second ``=`` is ignored."""
    pairs = []
    for item in items:
        key, found, rest = item.partition("=")
        if not found:
            raise ValueError(f"metadata {item!r} is not KEY=VALUE")
        pairs += [F.lit(key.strip()), F.lit(rest.split("=")[0].strip())]
    return F.create_map(*pairs) if pairs else F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")


def run_record(config: dict, metrics: DataFrame, metadata: list[str] | None = None) -> DataFrame:
    """One row: run configuration merged with the metrics, which win on a clash."""
    own = [F.lit(v).alias(k) for k, v in config.items() if k not in metrics.columns]
    return metrics.select(*own, metadata_map(metadata or []).alias("metadata"), "*")


def metric_records(record: DataFrame) -> DataFrame:
    """The named metrics as rows of one-element arrays; other light fields as a map.

    A metric the run did not compute is a NULL element.
    """
    present = set(record.columns)
    others = [c for c in record.columns if c not in RECORD_METRICS and c not in BULKY_FIELDS]
    extra = F.map_from_arrays(
        F.array(*[F.lit(c) for c in others]),
        F.array(*[
            F.to_json(F.col(f"`{c}`")) if record.schema[c].dataType.typeName() in ("map", "struct", "array")
            else F.col(f"`{c}`").cast("string")
            for c in others
        ]),
    )
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"),
            F.array((F.col(m) if m in present else F.lit(None)).cast("double")).alias("value"),
        )
        for m in RECORD_METRICS
    ])
    return record.select(F.explode(rows).alias("_r"), extra.alias("extra_info")).select(
        "_r.metric", "_r.value", "extra_info"
    )
