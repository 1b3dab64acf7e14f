import pytest
from pyspark.sql import functions as F

from loadscope.operators import arrivals, serving
from loadscope.session import shared_path
from loadscope.streaming import metrics

LOG = "request_guid bigint, is_warmup_request int, decoding_step_idx int, timestamp_us bigint"


def run(spark, stream, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", shared_path(spark, name)).start()
    )
    query.awaitTermination(120)
    return spark.table(name)


def write(df, path):
    df.coalesce(1).write.parquet(path)


def test_request_latencies_match_the_batch(spark):
    marks = [
        (g, 0, step, (g * 1000 + t) * 1_000)
        for g in range(5)
        for step, t in ((-2, 0), (-1, 100), (0, 300), (1, 400), (2, 700))
    ]
    log = spark.createDataFrame(marks, LOG)
    path = shared_path(spark, "stream_log")
    write(log, path)
    write(spark.createDataFrame([(99, 0, -2, 900_000_000)], LOG), path + "-end")  # moves the watermark on
    source = spark.readStream.schema(LOG).parquet(path + "*")
    got = {r.request_guid: tuple(r)[1:] for r in run(spark, metrics.request_latencies(source), "lat").collect()}
    want = {r.request_guid: tuple(r)[1:] for r in serving.per_request(log).collect()}
    assert set(got) - {99} == set(want)
    for guid in want:
        assert got[guid] == pytest.approx(want[guid])


def test_rates_match_the_batch(spark):
    log = spark.range(100).select((F.col("id") * 0.3).alias("s"), F.timestamp_micros((F.col("id") * 300_000)).alias("ts"))
    path = shared_path(spark, "stream_arrivals")
    write(log, path)
    write(spark.range(1).select(F.lit(900.0).alias("s"), F.timestamp_micros(F.lit(900_000_000)).alias("ts")), path + "-end")
    source = spark.readStream.schema(log.schema).parquet(path + "*")
    got = run(spark, metrics.arrival_rates(source, "ts"), "rates").orderBy("start").collect()
    want = arrivals.rate_histogram(log, "s").orderBy("bin").collect()
    assert [r.rate for r in got] == [r.rate for r in want]
