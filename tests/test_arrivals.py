import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from loadscope.functions.randomness import choice, uniform
from loadscope.operators import arrivals


def by_id(df, col="arrival_time"):
    return np.array([r[col] for r in df.orderBy("id").collect()], dtype=float)


def test_uniform_is_uniform_and_fixed(spark):
    draws = [by_id(spark.range(20_000).repartition(p).select("id", uniform(F.col("id"), 7).alias("arrival_time"))) for p in (1, 16)]
    assert (draws[0] == draws[1]).all() and 0 < draws[0].min() and draws[0].max() < 1
    assert abs(draws[0].mean() - 0.5) < 5 * math.sqrt(1 / 12 / 20_000)
    assert set(r[0] for r in spark.range(200).select(choice(["a", "b", "c"], F.col("id"), 1)).collect()) == {"a", "b", "c"}


def test_poisson(spark):
    one = by_id(arrivals.poisson(spark.range(20_000), "id", 4.0, 1))
    many = by_id(arrivals.poisson(spark.range(20_000).repartition(16), "id", 4.0, 1))
    assert (one == many).all() and (np.diff(one) >= 0).all() and one[0] > 0
    gap = arrivals.mean_gap(arrivals.poisson(spark.range(20_000), "id", 4.0, 1)).first()[0]
    assert gap == pytest.approx(0.25, abs=0.25 * 5 / math.sqrt(20_000))
    assert gap == pytest.approx(np.diff(one).mean())
    assert (np.round(one, 6) == one).all()


@pytest.mark.parametrize("shape", [0.3, 0.9, 2.5, 1.0])
def test_bursty(spark, shape):
    n, rate = 20_000, 2.0
    one = by_id(arrivals.bursty(spark.range(n), "id", rate, 3, shape))
    many = by_id(arrivals.bursty(spark.range(n).repartition(7), "id", rate, 3, shape))
    assert (one == many).all() and one[0] == 0.0
    gaps = np.diff(one)
    assert gaps.mean() == pytest.approx(1 / rate, rel=5 / math.sqrt(n * shape))
    assert gaps.var() == pytest.approx(1 / rate**2 / shape, rel=0.15)


def test_bursty_limits(spark):
    assert set(by_id(arrivals.bursty(spark.range(5), "id", float("inf"), 1, 0.5))) == {0.0}
    with pytest.raises(ValueError):
        arrivals.bursty(spark.range(5), "id", 1.0, 1, 0.0)


def test_gamma_draws_depend_on_id_alone():
    ids = np.arange(5000)
    whole = arrivals.gamma_draws(ids, 0.7, 11)
    parts = np.concatenate([arrivals.gamma_draws(p, 0.7, 11) for p in np.array_split(ids, 13)])
    assert (whole == parts).all() and (arrivals.gamma_draws(ids, 0.7, 12) != whole).any()


@pytest.fixture(scope="module")
def log(spark):
    # 4 per second for 10 s from an offset, then one event exactly on second 10
    times = [7_000_000 + s * 1_000_000 + k * 250_000 for s in range(10) for k in range(4)] + [17_000_000]
    return spark.createDataFrame([(t,) for t in times], "t_us bigint").repartition(3)


def test_replay_keeps_the_shape(log):
    # 41 events in 10 s; twice the rate: 4 * 8.2 / 4.1 = 8 per second exactly, and the last event has no bucket
    out = arrivals.replay(log, "t_us", 8.2, 80, 1).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(80))
    assert [r.arrival_time for r in out] == [float(s) for s in range(10) for _ in range(8)]
    assert arrivals.replay(log, "t_us", 8.2, 13, 1).count() == 13


def test_replay_too_short(log):
    with pytest.raises(PySparkException):
        arrivals.replay(log, "t_us", 8.2, 81, 1).collect()
    with pytest.raises(ValueError):
        arrivals.replay(log, "t_us", 8.2, 81, 1, on_short="other")
    wrapped = arrivals.replay(log, "t_us", 8.2, 170, 1, on_short="wrap").orderBy("ordinal").collect()
    times = [r.arrival_time for r in wrapped]
    assert len(times) == 170 and times[:80] == [float(s) for s in range(10) for _ in range(8)]
    assert times[80:160] == [t + 9.0 for t in times[:80]] and times[160] == 18.0


def test_replay_rounds_by_chance(log):
    out = arrivals.replay(log, "t_us", 0.5 * 4.1, 1, 5)
    assert out.count() == 1
    sizes = [len(rows(arrivals.replay(log, "t_us", 1.5 * 4.1, 50, seed))) for seed in (1, 2)]
    assert sizes == [50, 50]


def test_replay_emits_a_crowded_second_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(arrivals, "_EMIT", 16)
    log = spark.range(200).select(F.when(F.col("id") < 190, 100).otherwise((F.col("id") - 189) * 1_000_000).cast("bigint").alias("t_us"))
    out = arrivals.replay(log, "t_us", 20.0, 195, 1).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(195))
    assert [r.arrival_time for r in out] == sorted(r.arrival_time for r in out)


def stamped(spark, times):
    return spark.createDataFrame(list(enumerate(float(t) for t in times)), "id bigint, t double")


def test_slice(spark):
    df = stamped(spark, np.arange(0, 100, 0.5))
    out = arrivals.time_slice(df, "t", 10, 1).toPandas()
    assert 19 <= len(out) <= 20 and out.t.min() >= 0 and out.t.max() < 10
    assert (np.diff(out.sort_values("id").t) == 0.5).all()
    for duration in (99.5, 200):
        with pytest.raises(ValueError):
            arrivals.time_slice(df, "t", duration, 1)
    with pytest.raises(ValueError):
        arrivals.time_slice(df.where("false"), "t", 1, 1)


@pytest.mark.parametrize("rate,size", [(0.5, 24), (1.0, 49), (2.3, 112), (50 / 49, 50)])
def test_scale_rate(spark, rate, size):
    df = stamped(spark, range(50))
    out = arrivals.scale_rate(df, "id", "t", rate).toPandas()
    assert len(out) == size == int(rate * 49) if size != 50 else len(out) == 50
    assert out.t.min() == 0 and not out.duplicated(["id", "copy"]).any()
    base = out.t + 0  # every row stays within a tenth of the smallest gap of its original
    shift = (base - out.id).min()
    assert ((base - out.id - shift) <= 0.1 + 1e-9).all()


def test_upsample_makes_many_copies_in_chunks(spark, monkeypatch):
    df = stamped(spark, range(3))
    whole = sorted(rows(arrivals.scale_rate(df, "id", "t", 50.0).select("id", "copy", "t")))
    monkeypatch.setattr(arrivals, "_EMIT", 7)
    assert sorted(rows(arrivals.scale_rate(df, "id", "t", 50.0).select("id", "copy", "t"))) == whole
    assert len(whole) == 100


def test_min_gap(spark):
    assert arrivals.min_gap(stamped(spark, [5, 1, 2.5, 9]), "t").first()[0] == 1.5
    assert arrivals.min_gap(stamped(spark, [5, 1, 5]), "t").first()[0] == 0.0
    assert arrivals.min_gap(stamped(spark, [5]), "t").first()[0] is None


def test_histogram_bins(spark):
    # the maximum lies on an edge and belongs to the last bin; bin 1 is empty
    df = stamped(spark, [0, 4.9, 10, 12, 15]).withColumn("w", F.lit(3))
    out = sorted(rows(arrivals.rate_histogram(df, "t", 5)))
    assert out == [(0, 2.5, 0.4), (1, 7.5, 0.0), (2, 12.5, 0.6)]
    want, _ = np.histogram([0, 4.9, 10, 12, 15], bins=np.arange(0, 20, 5))
    assert [r[2] * 5 for r in out] == list(want)
    assert [r[2] for r in sorted(rows(arrivals.rate_histogram(df, "t", 5, "w")))] == pytest.approx([1.2, 0, 1.8])
    assert arrivals.rate_histogram(df.where("false"), "t").count() == 0
    assert rows(arrivals.rate_report(df, "t")) == [(5, 15.0, 1 / 3)]
    assert rows(arrivals.rate_report(df.where("false"), "t")) == [(0, None, None)]


def test_edges_in_unsorted_pandas_order(spark):
    frame = pd.DataFrame({"id": range(500), "t": np.random.default_rng(3).uniform(0, 97, 500)})
    got = [r.rate for r in arrivals.rate_histogram(spark.createDataFrame(frame), "t", 5).orderBy("bin").collect()]
    want, _ = np.histogram(frame.t, bins=np.arange(0, frame.t.max() + 5, 5))
    assert np.allclose(got, want / 5)
