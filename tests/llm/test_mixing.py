import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from loadscope.llm import mixing, queries

SCHEMA = "doc_id bigint, text string, source string"


def documents(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("size", F.lit("clash")).withColumn("target", F.lit(0)).withColumn("place", F.lit(None).cast("int"))


def level(sizes, weights, share, cap):
    """Targets by resharing the excess until none is above its cap."""
    total, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > cap * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = left * weights[k] / whole
            break
        for k in over:
            targets[k] = cap * sizes[k]
            left -= targets[k]
            open_.remove(k)
    return targets


def rows_of(rng, per_source):
    rows, i = [], 0
    for source, n in per_source.items():
        for _ in range(n):
            rows.append((i := i + 1, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))), source))
    return rows


@pytest.mark.parametrize("per_source", [{"a": 300, "b": 20, "c": 5, "d": 80, None: 30}, {"x": 40}, {"é": 10, "z": 200, "Z": 3}])
def test_targets_and_taken(spark, per_source):
    rows = rows_of(random.Random(2), per_source)
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sources = sorted((s for s in per_source if s is not None), key=lambda s: s.encode()) + [None] * (None in per_source)
    size = {i: len(t.split()) for i, t, _ in rows}
    sizes = [sum(size[i] for i, _, s in rows if s == x) for x in sources]
    want = level(sizes, [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5, 2)
    for k, source in enumerate(sources):
        own = [r for r in got if r.source == source]
        assert all(math.isclose(r.target, want[k], rel_tol=1e-12) and r.source_size == sizes[k] for r in own)
        assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in own)
        assert want[k] - sum(r.taken for r in own) == pytest.approx(0, abs=max(size.values()) / 4)
    assert sorted(map(tuple, mixing.mix(documents(spark, rows).repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_time_inverts_cumulative_demand(spark):
    schedules = ((4.0, 2.0), (1.0, 1.0), (0.0, 3.0, 1.0))
    for no, knots in enumerate(schedules):
        df = spark.range(1, 100).select((F.col("id") / 100).alias("q"))
        for q, t in df.select("q", mixing.time_of(F.col("q"), F.lit(no), schedules)).collect():
            steps, n = len(knots) - 1, 4000
            weight = lambda x: knots[min(steps - 1, int(x * steps))] + (x * steps - min(steps - 1, int(x * steps))) * (
                knots[min(steps - 1, int(x * steps)) + 1] - knots[min(steps - 1, int(x * steps))])
            area = sum(weight((k + 0.5) * t / n) * t / n for k in range(n)) / mixing.integral(knots)
            assert area == pytest.approx(q, abs=1e-5)


def test_curriculum_reads_documents_as_often_as_planned(spark):
    rows = rows_of(random.Random(4), {"a": 60, "b": 9, "c": 20}) + [(900, None, "a"), (901, "", None), (902, "two words", "b"), (902, "two words", "b")]
    df = documents(spark, rows)
    plan = mixing.mix(df).collect()
    out = mixing.curriculum(df)
    assert out.columns == df.columns
    reads = {}
    for r in out.collect():
        reads[r.doc_id] = reads.get(r.doc_id, 0) + 1
    want = {}
    for r in plan:
        n = r.copies if r.size else 1
        if n:
            want[r.doc_id] = want.get(r.doc_id, 0) + n
    assert reads == want
    # the falling schedule of source a puts its words earlier than the rising one of source c
    order = [r.source for r in out.collect()]
    mean = lambda s: sum(k for k, x in enumerate(order) if x == s) / order.count(s)
    assert mean("a") < mean("c")


def test_dealt_counts_the_reads_of_the_curriculum(spark):
    rows = rows_of(random.Random(5), {"a": 50, "b": 9, "c": 20, None: 7}) + [(900, None, "a"), (901, "", None), (902, "two words", "b"), (902, "two words", "b")]
    df = documents(spark, rows)
    key = lambda r: (r.doc_id, r.size, r.source_size, r.target, r.taken)
    got = mixing.dealt(df).collect()
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df).collect()))
    assert all((r.first_time is None) == (r.taken == 0) for r in got)
    assert all(0 <= r.first_time <= r.last_time <= 1 and (r.first_time < r.last_time) == (r.taken > r.size) for r in got if r.taken)
    # by half of the training, the falling schedule of source a asks for 7 of 12 of its words, the rising one of source c for 5 of 12
    for source, share in (("a", 7 / 12), ("b", 1 / 2), ("c", 5 / 12)):
        plan = mixing.reads(mixing.mix(df).where(F.col("source") == source)).collect()
        early = sum(r.size for r in plan if r.time <= 0.5)
        assert early / plan[0].target == pytest.approx(share, abs=0.1)


def test_query_deals_the_reads_by_training_time(spark, sf_dir, monkeypatch):
    """The query's rows come from the written reads: one that the curriculum loses is missing in what is taken."""
    plan = queries.QUERIES["op8_mixing"](spark, sf_dir)
    assert sum(r.taken for r in plan.collect()) > 0
    reads = mixing.reads
    monkeypatch.setattr(mixing, "reads", lambda *a: reads(*a).where("time > 0.5"))
    late = queries.QUERIES["op8_mixing"](spark, sf_dir)
    assert 0 < sum(r.taken for r in late.collect()) < sum(r.taken for r in plan.collect())


def test_empty_tables_and_texts(spark):
    assert mixing.dealt(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.curriculum(documents(spark, [])).collect() == []
    got = mixing.mix(documents(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def first_in_hash_order(n):
    return min(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


def test_gap_before_a_dominating_text_is_filled(spark):
    """One text of 20,000 words first, then 100 of 50: target 37,500 of 25,000 words, 12,500 missing in the second pass."""
    long = first_in_hash_order(101)
    rows = [(i, "w " * (20_000 if i == long else 50), "a") for i in range(101)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert {(r.target, r.copies) for r in got if r.doc_id == long} == {(37_500.0, 1)}
    assert sum(r.taken for r in got) == 25_000 + 100 * 50  # all that fits
    places = sorted(r.filled for r in got if r.filled is not None)
    assert places == [50.0 * k for k in range(100)]


def test_nothing_that_fits_is_left(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([1, 2, 3, 7, 40, 300, 2000]), rng.choice("abc")) for i in range(300)]
    got = mixing.mix(documents(spark, rows)).collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        gap = own[0].target - sum(r.taken for r in own)
        least = min(r.copies for r in own)
        assert gap >= 0 and all(r.size > gap for r in own if r.copies == least and r.target > r.source_size * least)
