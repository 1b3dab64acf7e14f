import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loadscope.operators import client

RECORDS = (
    "request_id bigint, success boolean, prompt_len int, output_tokens int, ttft_s double, "
    "latency_s double, itl_s array<double>, generated_text string"
)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(
        [
            (1, True, 10, 5, 0.1, 0.5, [0.1, 0.1, 0.1, 0.1], "x"),
            (2, True, 20, None, 0.2, 1.2, [0.5, 0.5], "a b  c"),
            (3, True, 30, 1, 0.3, 0.3, [], "y"),
            (4, False, 40, 9, 0.0, 0.0, [9.0], "z"),
        ],
        RECORDS,
    )


def test_output_lengths(records):
    got = dict(rows(client.output_lengths(records).select("request_id", "output_len")))
    assert got == {1: 5, 2: 3, 3: 1, 4: 0}


def test_summary(records):
    s = client.summary(records, 2.0, {"ttft": 250.0, "tpot": 100.0}).first()
    assert (s.completed, s.total_input_tokens, s.total_output_tokens) == (3, 60, 9)
    assert (s.request_throughput, s.output_throughput, s.total_token_throughput) == (1.5, 4.5, 34.5)
    assert s.request_goodput == pytest.approx(0.5)  # only request 1: 2 is slow per token, 3 late


def test_one_token_counts_as_zero_for_goodput_only(records):
    assert client.summary(records, 1.0, {"tpot": 0.0}).first().request_goodput == 1.0
    block = client.latency_blocks(records, ("tpot",)).first()
    assert block.mean_tpot_ms == pytest.approx((100 + 500) / 2)
    assert block.std_tpot_ms == pytest.approx(200.0)  # population deviation


def test_no_objectives_and_no_successes(spark, records):
    assert client.summary(records, 1.0).first().request_goodput == 0.0
    failed = records.where("not success")
    assert client.summary(failed, 1.0, {"ttft": 1.0}).first()[1:4] == (0, 0, 0)
    assert all(v == 0 for v in client.latency_blocks(failed).first())
    assert client.summary(records, 0.0).first().request_throughput is None


def test_gaps_are_flattened_over_successes(records):
    block = client.gap_block(client.gaps(records), (50.0, 99.9)).first()
    assert block.mean_itl_ms == pytest.approx((0.4 + 1.0) / 6 * 1000)
    assert block["p50_itl_ms"] == pytest.approx(100.0) and "p99.9_itl_ms" in block.asDict()


def test_objectives():
    assert client.parse_slo(["ttft:100", "tpot:5.5", "ttft:7"]) == {"ttft": 7.0, "tpot": 5.5}
    assert client.parse_slo(None) == {}
    for wrong in (["ttft"], ["ttft:x"], ["a:b:c"], ["itl:5"], ["tpot:-1"]):
        with pytest.raises(ValueError):
            client.parse_slo(wrong)


def test_run_record_metrics_win(spark, records):
    metrics = client.summary(records, 2.0)
    record = client.run_record({"backend": "b", "completed": -1}, metrics, [" a = 1=2", "b=x"])
    row = record.first()
    assert (row.backend, row.completed, row.metadata) == ("b", 3, {"a": "1", "b": "x"})
    assert client.run_record({}, metrics).first().metadata == {}
    with pytest.raises(ValueError):
        client.run_record({}, metrics, ["nokey"])


def test_metric_records(records):
    record = client.latency_blocks(records).withColumn("backend", F.lit("b")).withColumn("ttfts", F.array())
    out = {r.metric: (r.value, r.extra_info) for r in client.metric_records(record).collect()}
    assert len(out) == 12
    assert out["p99_itl_ms"][0] == [None] and out["mean_ttft_ms"][0] == [pytest.approx(200.0)]
    extra = out["mean_ttft_ms"][1]
    assert extra["backend"] == "b" and "ttfts" not in extra and json.loads(extra["mean_e2el_ms"]) > 0
