import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from loadscope.operators import steps

FT = "step_id bigint, run_idx int, is_warmup_step int, timestamp_us bigint, num_finetuning_fwd_tokens int, num_finetuning_bwd_tokens int"
STEP = (
    "step_id bigint, run_idx int, is_warmup_step int, timestamp_us bigint, num_decoding_tokens int, "
    "num_prefilling_tokens int, num_finetuning_fwd_tokens int, num_finetuning_bwd_tokens int, num_bwd_layers int"
)


def test_ft_throughput_and_balance(spark):
    log = spark.createDataFrame(
        [(1, 0, 0, 0, 99, 0), (2, 1, 1, 1, 99, 0), (3, 1, 0, 1_000_000, 64, 0), (4, 1, 0, 3_000_000, 0, 64), (5, 1, 0, 9_000_000, 0, 0)],
        FT,
    )
    assert rows(steps.ft_throughput(log, strict=True)) == [(64, 64, 2.0, True, 32.0)]
    uneven = log.where("step_id <> 4")
    assert steps.ft_throughput(uneven).first().is_balanced is False
    assert steps.ft_throughput(uneven).first().throughput is None  # one step: no span
    with pytest.raises(PySparkException):
        steps.ft_throughput(uneven, strict=True).collect()
    assert steps.ft_throughput(log.where("false")).first().fwd_tokens == 0


def test_series(spark):
    log = spark.createDataFrame(
        [
            (1, 0, 0, 0, 5, 0, 0, 0, 0),  # warm-up run
            (2, 1, 1, 1, 5, 0, 0, 0, 0),  # warm-up step
            (3, 1, 0, 1_000_000, 4, 0, 0, 0, 0),  # first: no difference
            (4, 1, 0, 2_000_000, 8, 0, 0, 0, 0),
            (5, 1, 0, 2_000_000, 8, 0, 0, 0, 0),  # same time: no rate
            (6, 1, None, 4_000_000, 10, 0, 0, 0, 0),  # unknown flag takes part in the order, then goes (NULL)
            (7, 2, 0, 5_000_000, 3, 0, 0, 0, 0),
            (8, 2, 0, 5_500_000, 0, 0, 0, 0, 0),  # nothing decoded
        ],
        STEP,
    )
    out = steps.throughput_series(log).select("step_id", "time_diff_sec", "throughput", "relative_time")
    assert sorted(rows(out)) == [(4, 1.0, 8.0, 0.0), (5, 0.0, None, 0.0), (7, 1.0, 3.0, 3.0)]
    stats = steps.describe_throughput(steps.throughput_series(log)).first()
    assert (stats["count"], stats["mean"], stats["min"], stats.p50, stats["max"]) == (2, 5.5, 3.0, 5.5, 8.0)
    assert steps.throughput_series(log.where("false")).count() == 0
    by_run = steps.throughput_series(log, ["run_idx"])
    assert sorted(r.step_id for r in by_run.collect()) == [4, 5]


def test_overheads_average_runs_evenly(spark):
    def step(i, run, t, fwd=0, bwd=0, layers=0, warm=0, decode=256):
        return (i, run, warm, t * 1000, decode, 0, fwd, bwd, layers)

    log = spark.createDataFrame(
        [
            step(1, 1, 0), step(2, 1, 10), step(3, 1, 20), step(4, 1, 60, fwd=1024),  # run 1: 10, 10 | 40
            step(5, 2, 0, decode=1), step(6, 2, 30),  # run 2: 30, after a step that is not selected
            step(7, 2, 35, bwd=4096, layers=8), step(8, 0, 36), step(9, 2, 37, warm=1),
        ],
        STEP,
    )
    times = steps.step_times(log)
    fwd = {r[0]: (r.step_time_ms, r.runs) for r in steps.fwd_overhead(times).collect()}
    assert fwd == {0: (20.0, 2), 1024: (40.0, 1), 2048: (None, 0), 3072: (None, 0), 4096: (None, 0)}
    bwd = {r[0]: r.step_time_ms for r in steps.bwd_overhead(times).collect()}
    assert bwd == {0: None, 8: 5.0, 16: None, 24: None, 32: None}


def test_run_index_and_ranges(spark):
    cells = spark.createDataFrame([(0, 0), (0, 32), (1024, 0), (4096, 32), (7, 0)], "f int, b int")
    got = [r[0] for r in cells.select(steps.run_index(F.col("f"), F.col("b"), strict=False)).collect()]
    assert got == [1, 5, 6, 25, None]
    with pytest.raises(PySparkException):
        cells.select(steps.run_index(F.col("f"), F.col("b"))).collect()
    ranges = {r.run_idx: (r.guid_lo, r.guid_hi) for r in steps.guid_ranges(spark).collect()}
    assert ranges[1] == (1_000_011, 1_000_019) and ranges[5] == (1_000_043, 1_000_051)
    assert ranges[6] == (1_000_051, 1_000_059) and ranges[7] == (1_000_060, 1_000_068)
    requests = spark.createDataFrame([(1_000_010,), (1_000_018,), (1_000_059,)], "request_guid bigint")
    assert rows(steps.with_run(requests).select("request_guid", "run_idx")) == [(1_000_018, 1)]
