"""Experiment grids, configuration tables and per-configuration comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadscope.operators import serving
from loadscope.operators.checks import require_rows

CONFIG = ["dataset", "model", "max_batch_size", "max_tokens_per_batch"]


# -- grids ----------------------------------------------------------------------


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the listed values."""
    row = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(a) for a, vs in axes.items()])
    return _spread(row, list(axes))


def observed_grid(log: DataFrame, axes: list[str]) -> DataFrame:
    """Every combination of the configuration values seen in a log.

    The values are configuration (a handful per axis), whatever the log's size.
    """
    return _spread(log.agg(*[F.collect_set(a).alias(a) for a in axes]), axes)


def _spread(arrays: DataFrame, axes: list[str]) -> DataFrame:
    for axis in axes:
        rest = [F.col(a) for a in arrays.columns if a != axis]
        arrays = arrays.select(*rest, F.explode(axis).alias(axis))
    return arrays.select(*axes)


def feasible(cells: DataFrame) -> DataFrame:
    """A batch needs at least one token per request."""
    return cells.where(F.col("max_tokens_per_batch") >= F.col("max_batch_size"))


def missing_cells(cells: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid without any observation."""
    return cells.join(observed.select(*keys).distinct(), keys, "left_anti")


def task_index(task: Column, sizes: dict[str, int]) -> dict[str, Column]:
    """Positions on each axis of a flat task number; the last axis runs fastest."""
    out: dict[str, Column] = {}
    inner = 1
    for axis, size in reversed(sizes.items()):
        out[axis] = (F.floor(task / inner) % size).cast("int")
        inner *= size
    return dict(reversed(out.items()))


def zip_config(spark: SparkSession, lists: dict[str, list], explode: str | None = None) -> DataFrame:
    """Parallel lists as one row per position; ``explode`` unfolds a list of lists."""
    if len({len(v) for v in lists.values()}) > 1:
        raise ValueError("configuration lists differ in length")

    def literal(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)

    zipped = F.arrays_zip(*[F.array(*[literal(v) for v in vs]).alias(a) for a, vs in lists.items()])
    rows = spark.range(1).select(F.explode(zipped).alias("_z")).select("_z.*").toDF(*lists)
    return rows.withColumn(explode, F.explode(explode)) if explode else rows


# -- competitor results ---------------------------------------------------------

RESULT_KEY = ["model", "dataset", "v1", "eager"]


def duplicate_keys(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or RESULT_KEY
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def lookup(results: DataFrame, expected: DataFrame, *, strict: bool = True) -> DataFrame:
    """The expected cells with their results; a duplicate raises, a missing cell raises if strict."""
    unique = results.groupBy(*RESULT_KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.any_value("mean_tpot_ms").alias("mean_tpot_ms"),
        F.any_value("output_throughput").alias("output_throughput"),
    )
    joined = expected.join(unique, RESULT_KEY, "left")
    joined = require_rows(joined, F.coalesce("rows", F.lit(1)) == 1, "duplicate result key")
    if strict:
        joined = require_rows(joined, F.col("rows").isNotNull(), "a result file is missing")
    return joined.drop("rows")


# -- comparisons ----------------------------------------------------------------


def throughput(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or CONFIG
    return serving.marks_throughput(marks, keys).select(*keys, "throughput")


def mean_tpot(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means need no order, so no quantile pass."""
    keys = keys or CONFIG
    return serving.request_latencies(marks, keys).groupBy(*keys).agg(F.avg("tpot_ms").alias("mean_tpot_ms"))


def tpot_and_throughput(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both per configuration in one aggregate over the per-request marks."""
    keys = keys or CONFIG
    named = F.col("request_guid").isNotNull() & (F.col("tokens") > 0)
    tpot = (F.col("last_us") - F.col("first_us")) / F.col("tokens") / F.lit(1e3)
    span = (F.max("last_us") - F.min("first_us")) / F.lit(1e6)
    return (
        marks.groupBy(*keys)
        .agg(F.avg(F.when(named, tpot)).alias("mean_tpot_ms"), F.sum("tokens").alias("_tokens"), span.alias("_span"))
        .select(*keys, "mean_tpot_ms", F.try_divide(F.col("_tokens"), F.col("_span")).alias("throughput"))
    )


def versus_baseline(marks: DataFrame, results: DataFrame) -> DataFrame:
    """One curve per batch size in order of tokens per batch, plus the competitor's points.

    A competitor configuration without a result is left out.
    """
    own = tpot_and_throughput(marks)
    along = W.partitionBy("dataset", "model", "max_batch_size").orderBy("max_tokens_per_batch")
    curve = own.select(
        "dataset",
        "model",
        F.concat(F.lit("batch "), F.col("max_batch_size").cast("string")).alias("series"),
        F.row_number().over(along).alias("position"),
        F.col("max_tokens_per_batch"),
        "mean_tpot_ms",
        "throughput",
    )
    shown = own.select("dataset", "model").distinct()
    label = F.concat(
        F.lit("baseline"),
        F.when(F.col("v1") == 1, " v1").otherwise(""),
        F.when(F.col("eager"), " (eager)").otherwise(""),
    )
    points = shown.join(results, ["dataset", "model"]).select(
        "dataset", "model", label.alias("series"), F.lit(1).alias("position"),
        F.lit(None).cast("int").alias("max_tokens_per_batch"), "mean_tpot_ms",
        F.col("output_throughput").alias("throughput"),
    )
    return curve.unionByName(points)


def tpot_curve(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and p99 TPOT of every configuration, positioned by throughput per data set and model."""
    keys = keys or CONFIG
    tpot = serving.latency(serving.request_latencies(marks, keys), "tpot_ms", keys)
    joined = tpot.select(*keys, "mean_tpot_ms", "p99_tpot_ms").join(throughput(marks, keys), keys)
    rest = [k for k in keys if k not in ("dataset", "model")]
    along = W.partitionBy("dataset", "model").orderBy("throughput", *rest)
    return joined.withColumn("position", F.row_number().over(along))


def latency_by(marks: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Mean and p99 of one latency per configuration."""
    stats = serving.latency(serving.request_latencies(marks, keys), metric, keys)
    return stats.select(*keys, f"mean_{metric}", f"p99_{metric}")
