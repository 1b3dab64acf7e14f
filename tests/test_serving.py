import pytest

from conftest import rows
from loadscope.operators import serving

LOG = "request_guid bigint, is_warmup_request int, decoding_step_idx int, timestamp_us bigint"


def log(spark, *entries):
    return spark.createDataFrame(list(entries), LOG)


@pytest.fixture(scope="module")
def edge(spark):
    return log(
        spark,
        (1, 0, -2, 0), (1, 0, -1, 2_000_000), (1, 0, 0, 5_000_000), (1, 0, 1, 6_000_000), (1, 0, 2, 8_000_000),
        (2, 0, -2, 0), (2, 0, -1, 1_000_000), (2, 0, 0, 2_000_000),  # one token
        (3, 0, -2, 0), (3, 0, 0, 4_000_000),  # never scheduled
        (4, 0, -1, 3_000_000), (4, 0, 0, 4_000_000),  # never queued
        (None, 0, 3, 9_000_000),  # no request id
        (9, 1, 0, 99_000_000),  # warm-up
    )


def test_per_request(edge):
    got = {r.request_guid: (r.tokens, r.tpot_ms, r.ttft_ms, r.queueing_s) for r in serving.per_request(edge).collect()}
    assert got == {
        1: (3, 1000.0, 3000.0, 2.0),
        2: (1, 0.0, 1000.0, 1.0),
        3: (1, 0.0, None, None),
        4: (1, 0.0, 1000.0, None),
    }


def test_latency_counts_incomplete(edge):
    requests = serving.per_request(edge)
    ttft = serving.latency(requests, "ttft_ms").first()
    assert (ttft.requests, ttft.incomplete, ttft.mean_ttft_ms, ttft.median_ttft_ms) == (3, 1, 5000 / 3, 1000.0)
    queue = serving.latency(requests, "queueing_s").first()
    assert (queue.requests, queue.incomplete, queue.mean_queueing_s, queue.median_queueing_s) == (2, 2, 1.5, 1.5)
    tpot = serving.latency(requests, "tpot_ms").first()
    assert tpot.mean_tpot_ms == 250.0 and tpot.p99_tpot_ms == pytest.approx(970.0)


def test_all_latencies_match_one_by_one(edge):
    got = {r.metric: (r.requests, r.incomplete, r["mean"], r["median"], r.p99) for r in serving.latencies(serving.per_request(edge)).collect()}
    for metric in serving.LATENCIES:
        one = serving.latency(serving.per_request(edge), metric).first()
        assert got[metric] == pytest.approx(tuple(one))


def test_throughput_counts_rows_without_request(edge):
    # six tokens with a request id, one without; 2 s to 9 s
    for out in (serving.throughput(edge), serving.marks_throughput(serving.request_marks(edge))):
        assert rows(out) == [(7, 7.0, 1.0)]


def test_zero_span_and_empty(spark):
    one = log(spark, (1, 0, 0, 5))
    assert serving.throughput(one).first().throughput is None
    empty = log(spark, (1, 1, 0, 5))
    assert serving.throughput(empty).first().throughput is None
    assert rows(serving.latency(serving.per_request(empty), "tpot_ms")) == [(0, 0, None, None, None)]


def test_hot_request_is_combined_before_the_shuffle(spark):
    marks = serving.request_marks(log(spark, (1, 0, 0, 5)))
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_") > plan.index("Exchange hashpartitioning")
