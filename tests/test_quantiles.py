import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadscope.operators import quantiles as module
from loadscope.operators.quantiles import quantiles

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    n = 30_000
    frame = pd.DataFrame({"k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n)), "x": rng.gamma(2, 3, n)})
    frame.loc[rng.random(n) < 0.35, "x"] = 5.0  # one value holds a third of the rows
    return frame, spark.createDataFrame(frame).repartition(6)


@pytest.mark.parametrize("rounds,bins", [(2, 1 << 16), (1, 50), (3, 20), (0, 10)])
def test_exact_with_any_number_of_rounds(values, rounds, bins):
    frame, df = values
    how = {"rounds": rounds, "bins": bins}
    got = quantiles(df, ["k"], ["x"], PROBS, extra={"mean": F.avg}, **how).toPandas().sort_values("k")
    groups = frame.groupby("k").x
    for name, p in PROBS.items():
        assert np.allclose(got[name], groups.quantile(p), rtol=1e-12)
    assert np.allclose(got["mean"], groups.mean()) and list(got["n"]) == list(groups.size())
    whole = quantiles(df, [], ["x"], PROBS, **how).toPandas()
    assert np.allclose(whole[list(PROBS)].iloc[0], frame.x.quantile(list(PROBS.values())), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 100, 1_000_000])
def test_one_path_for_every_size(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = quantiles(df, [], ["x"], {"p50": 0.5, "p99": 0.99}).first()
    assert (got.n, got.p50, got.p99) == (n, (n - 1) * 0.5, pytest.approx((n - 1) * 0.99))


def left_to_order(df):
    """Most different values that one task orders in the last step, and most bins in a step before."""
    values = df.select(F.lit("x").alias("metric"), "x")
    brackets = module._logarithmic(values, ["metric"], [0.01, 0.5, 0.99])
    for _ in range(module.ROUNDS):
        brackets = module._narrowed(values, brackets, ["metric"], module.BINS)
    return max(r.n for r in module._within(values, brackets, ["metric"]).groupBy("i").agg(F.countDistinct("x").alias("n")).collect())


#: Two hundred thousand neighbouring doubles beside two values that keep the brackets wide.
CROWD = "case id when 0 then 1.04D when 1 then 1D + pow(2D, -22) else 1D + (id % 200000) * pow(2D, -52) end"


@pytest.mark.parametrize("shape,most", [("id", 64), ("exp(rand(3) * 600 - 300)", 64), ("1 + rand(4)", 64), (CROWD, module.BINS)])
def test_what_is_ordered_does_not_grow(spark, shape, most):
    """A narrow range, a wide one and a crowd between outliers: at most a bin's width of doubles."""
    for n in (10_000, 1_000_000):
        assert left_to_order(spark.range(n).selectExpr(f"cast({shape} as double) x")) <= most


def test_neighbouring_doubles_and_odd_values(spark):
    """Ten thousand neighbouring doubles, both zeros, subnormals, infinities, NaN: as numpy orders them."""
    near = 1.0 + np.arange(10_000) * 2.0**-52
    for xs in (near, np.array([-0.0, 0.0, 5e-324, -5e-324, 1e-310]), np.array([-1e308, -3.0, -2.0, 4.0, 1e308])):
        df = spark.createDataFrame(pd.DataFrame({"x": xs})).repartition(3)
        got = quantiles(df, [], ["x"], PROBS).first()
        for name, p in PROBS.items():
            at = p * (len(xs) - 1)
            low, high = np.sort(xs)[[int(np.floor(at)), int(np.ceil(at))]]
            assert got[name] == (low if low == high else low + (high - low) * (at - np.floor(at)))
    odd = spark.createDataFrame([(float(v),) for v in ("-inf", "1", "2", "inf", "inf", "nan", "nan")], "x double")
    got = quantiles(odd, [], ["x"], {"p0": 0.0, "p50": 0.5, "p100": 1.0}).first()
    assert (got.p0, got.p50) == (float("-inf"), float("inf")) and np.isnan(got.p100)


def test_nulls_groups_without_values_and_empty_input(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None), (None, 7.0)], "k string, x double")
    got = {r.k: (r.n, r.p50) for r in quantiles(df, ["k"], ["x"], {"p50": 0.5}).collect()}
    assert got == {"a": (2, 2.0), "b": (0, None), None: (1, 7.0)}
    assert [tuple(r) for r in quantiles(df.where("false"), [], ["x"], {"p50": 0.5}).collect()] == [("x", 0, None)]
    assert quantiles(df.where("false"), ["k"], ["x"], {"p50": 0.5}).count() == 0


def test_several_columns_share_the_passes(values):
    frame, df = values
    two = df.withColumn("y", F.col("x") * -2)
    got = {r.metric: (r.n, r.p25) for r in quantiles(two, [], ["x", "y"], {"p25": 0.25}).collect()}
    assert got["x"] == pytest.approx((len(frame), frame.x.quantile(0.25)))
    assert got["y"] == pytest.approx((len(frame), (frame.x * -2).quantile(0.25)))
    keyed = quantiles(two, ["k"], ["x", "y"], {"p25": 0.25})
    assert keyed.count() == 2 * frame.k.nunique()
