import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadscope.operators import ordered
from loadscope.session import shared_dir


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows share one key and a third one time stamp."""
    rng = np.random.default_rng(0)
    n = 6000
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "k": np.where(rng.random(n) < 0.35, 7, rng.integers(0, 40, n)),
            "t": np.where(rng.random(n) < 0.35, 500, rng.integers(0, 1000, n)),
        }
    )
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_row_number_is_global_order(facts, parts):
    frame, df = facts
    got = ordered.row_number(df.repartition(parts), ["t", "id"], "rn", partitions=parts).toPandas()
    want = frame.sort_values(["t", "id"]).assign(rn=np.arange(1, len(frame) + 1))
    merged = got.merge(want, on="id")
    assert len(merged) == len(frame) and (merged.rn_x == merged.rn_y).all()


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_row_number_by_key_crosses_runs(facts, parts):
    frame, df = facts
    got = ordered.row_number(df, ["t", "id"], "rn", keys=["k"], partitions=parts).toPandas()
    want = frame.sort_values(["k", "t", "id"])
    want = want.assign(rn=want.groupby("k").cumcount() + 1)
    merged = got.merge(want, on="id")
    assert (merged.rn_x == merged.rn_y).all()


def test_hot_key_and_hot_stamp_are_cut(facts):
    frame, df = facts
    for order in (["t", "id"], ["k", "t", "id"]):
        sizes = ordered.sorted_runs(df, order, 12).groupBy("_run").count().toPandas()["count"]
        assert sizes.max() < len(frame) / 5


@pytest.mark.parametrize("keys", [None, ["k"]])
@pytest.mark.parametrize("parts", [1, 7])
def test_lag(facts, keys, parts):
    frame, df = facts
    got = ordered.lag(df, ["t", "id"], {"p": "t"}, keys=keys, partitions=parts).toPandas()
    want = frame.sort_values([*(keys or []), "t", "id"])
    want = want.assign(p=want.groupby("k").t.shift() if keys else want.t.shift())
    merged = got.merge(want, on="id")
    assert np.array_equal(merged.p_x.astype(float), merged.p_y, equal_nan=True)


def test_lag_of_null_keeps_null_and_key_null_is_a_key(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, None), (3, None, 7), (4, "a", 9)], "id int, k string, v int")
    got = {r.id: r.p for r in ordered.lag(df, ["id"], {"p": "v"}, keys=["k"], partitions=3).collect()}
    assert got == {1: None, 2: 5, 3: None, 4: None}


@pytest.mark.parametrize("cell", [7, 1000, 1 << 16])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_sum(facts, cell, inclusive):
    frame, df = facts
    got = ordered.prefix_sum(df, "id", "t", "s", cell=cell, inclusive=inclusive).toPandas().sort_values("id")
    want = frame.t.cumsum() - (0 if inclusive else frame.t)
    assert (got.s.to_numpy() == want.to_numpy()).all()


def test_prefix_sum_of_sparse_ids(spark):
    ids = [3, 70_000, 5_000_000, 5_000_001, 9_000_000_000_000]
    df = spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id bigint, v bigint")
    for cell in (16, 1 << 16):
        got = {r.id: r.s for r in ordered.prefix_sum(df, "id", "v", "s", cell=cell).collect()}
        assert got == dict(zip(ids, [1, 3, 6, 10, 15], strict=True))


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_hash_rank_does_not_depend_on_partitions(facts, parts):
    frame, df = facts
    got = ordered.hash_rank(df.repartition(parts), F.col("id"), 42, "r", bits=6).toPandas().sort_values("r")
    assert (got.r.to_numpy() == np.arange(len(frame))).all()
    first = ordered.hash_rank(df, F.col("id"), 42, "r", upto=100, bits=6).toPandas().sort_values("r")
    assert list(first.id) == list(got.id[:100])


def test_hash_rank_keep_ranks_survivors_only(facts):
    frame, df = facts
    even = ordered.hash_rank(df, F.col("id"), 1, "r", upto=50, keep=lambda d: d.where("id % 2 = 0")).toPandas()
    whole = ordered.hash_rank(df.where("id % 2 = 0"), F.col("id"), 1, "r").toPandas().sort_values("r")
    assert list(even.sort_values("r").id) == list(whole.id[:50])


@pytest.mark.parametrize("n,modulus,most", [(50, 2, 1000), (50, 150, 18_000), (10, 10_000, 18_000)])
def test_hash_rank_stops_early(facts, spark, n, modulus, most):
    """Rows are looked at for a few times ``n`` only; all of them, at most three times, where few are kept."""
    frame, df = facts
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch[batch["id"] % modulus == 0]

    got = ordered.hash_rank(df, F.col("id"), 1, "r", upto=n, keep=lambda d: d.mapInPandas(look, d.schema)).toPandas()
    whole = ordered.hash_rank(df.where(F.col("id") % modulus == 0), F.col("id"), 1, "r").toPandas().sort_values("r")
    assert list(got.sort_values("r").id) == list(whole.id[:n])
    assert seen.value < most


@pytest.mark.parametrize("n", [0, 25, 4000, 9000])
@pytest.mark.parametrize("cell", [9, 1 << 16])
def test_first_by_id(facts, n, cell):
    _, df = facts
    for step, shift in ((1, 0), (11, -500)):
        ids = df.withColumn("id", F.col("id") * step + shift)
        got = ordered.first_by_id(ids, "id", n, "o", cell=cell).toPandas().sort_values("o")
        have = min(n, df.count())
        assert list(got.o) == list(range(have)) and list(got.id) == [i * step + shift for i in range(have)]


def test_order_is_planned_without_a_job(facts, spark):
    """Nothing is written or counted when a lag or a row number is planned, and the rows are shuffled once."""
    _, df = facts
    group = spark.sparkContext.statusTracker()
    before = group.getJobIdsForGroup(None)
    lagged = ordered.lag(df, ["t", "id"], {"p": "t"}, keys=["k"])
    ordered.row_number(df, ["t", "id"], "rn")
    assert group.getJobIdsForGroup(None) == before
    plan = lagged._jdf.queryExecution().executedPlan().toString()
    # whole rows by run, and the last row of a run of every task
    assert plan.count("Exchange hashpartitioning(_run") == 2


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id bigint, k int, t bigint")
    assert ordered.row_number(empty, ["t", "id"], "rn").count() == 0
    assert ordered.lag(empty, ["t", "id"], {"p": "t"}, keys=["k"]).count() == 0
    assert ordered.prefix_sum(empty, "id", "t", "s").count() == 0
    assert ordered.hash_rank(empty, F.col("id"), 1, "r", upto=5).count() == 0
    assert ordered.first_by_id(empty, "id", 5, "o").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("n", [0, 1, 7, 1999, 5999, 6000, 9000])
@pytest.mark.parametrize("bits", [2, 16])
def test_hash_first_is_the_head_of_the_shuffle(facts, n, bits):
    frame, df = facts
    ranked = ordered.hash_rank(df, F.col("id"), 5, "rank").where(F.col("rank") < n).toPandas()
    got = ordered.hash_first(df.repartition(3), F.col("id"), 5, n, bits=bits).toPandas()
    assert sorted(got.id) == sorted(ranked.id) and len(got) == min(n, len(frame))


def test_hash_first_shuffles_no_rows(facts, spark):
    _, df = facts
    head = ordered.hash_first(df, F.col("id"), 5, 100)
    plan = head._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Filter") and head.columns == df.columns
    assert ordered.hash_first(df.where("false"), F.col("id"), 5, 10).collect() == []
