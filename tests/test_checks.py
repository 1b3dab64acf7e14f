"""Strict operators raise whatever is read of their result."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loadscope.operators import arrivals, datasets, steps, sweeps, traces


def unequal_steps(spark):
    schema = "is_warmup_step int, run_idx int, timestamp_us bigint, num_finetuning_fwd_tokens int, num_finetuning_bwd_tokens int"
    return steps.ft_throughput(spark.createDataFrame([(0, 1, 0, 5, 0), (0, 1, 1_000_000, 0, 4)], schema), strict=True)


def few_rows(spark, n=5):
    rows = spark.range(n).select("id", F.lit("x").alias("text"))
    return datasets.first_n(rows, "id", 9, strict=True)


def duplicate_key(spark):
    schema = "model string, dataset string, v1 int, eager boolean, mean_tpot_ms double, output_throughput double"
    results = spark.createDataFrame([("m", "d", 1, True, 1.0, 2.0), ("m", "d", 1, True, 3.0, 4.0)], schema)
    return sweeps.lookup(results, results.select(*sweeps.RESULT_KEY).distinct())


def missing_key(spark):
    schema = "model string, dataset string, v1 int, eager boolean, mean_tpot_ms double, output_throughput double"
    results = spark.createDataFrame([("m", "d", 1, True, 1.0, 2.0)], schema)
    return sweeps.lookup(results, results.select(F.lit("n").alias("model"), "dataset", "v1", "eager"))


def malformed_exchange(spark):
    schema = "id int, model string, turn int, language string, conversation array<struct<role:string,content:string>>"
    return traces.filter_corpus(spark.createDataFrame([(1, "gpt-4", 1, "English", [("user", "a")])], schema))


def pairs(spark, n):
    return spark.range(n).select("id", F.lit("a b").alias("prompt"), F.lit("c").alias("response"))


def more_rows_than_pairs(spark):
    return traces.attach_pairs(spark.range(6).withColumnRenamed("id", "t"), pairs(spark, 3), "id", 10, 1, order=["t"])


def short_schedule(spark):
    entries = traces.sample_entries(pairs(spark, 5), "id", 5, 10, 1)
    return traces.with_arrivals(entries, spark.range(3).select(F.col("id").alias("ordinal"), F.lit(0.5).alias("arrival_time")))


def few_candidates(spark, n=5):
    return traces.sample_entries(pairs(spark, n), "id", 3, 10, 1, candidates=9)


def short_log(spark):
    return arrivals.replay(spark.range(5).select((F.col("id") * 1_000_000).alias("t")), "t", 1.0, 50, 1)


CASES = [unequal_steps, few_rows, duplicate_key, missing_key, malformed_exchange, more_rows_than_pairs, short_schedule, few_candidates, short_log]


@pytest.mark.parametrize("case", CASES)
def test_checks_fire_under_any_read(spark, case):
    df = case(spark)
    with pytest.raises(PySparkException):
        df.count()
    for column in df.columns:
        with pytest.raises(PySparkException):
            df.select(column).collect()


@pytest.mark.parametrize("case", [few_rows, few_candidates])
def test_checks_fire_on_empty_input(spark, case):
    with pytest.raises(PySparkException):
        case(spark, 0).count()
