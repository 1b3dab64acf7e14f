import math

import numpy as np
from pyspark.sql import functions as F

from loadscope.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).withColumn("rep", F.lit("clash")).withColumn("vec", F.lit(1))


def brute_force(rows, threshold):
    good = [(i, np.array(v) / max(map(abs, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[i] = (len(links[i]), min(seen) if i is not None else None, i == min(seen) if i is not None else True)
    return out


def clusters(rng, n, size, dim, noise):
    rows = []
    for _ in range(n):
        base = rng.standard_normal(dim)
        rows += [(base + noise * rng.standard_normal(dim)) * rng.uniform(0.1, 9) for _ in range(size)]
    return [(k * 3, v.tolist()) for k, v in enumerate(rows)]


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_odd_vectors_and_small_clusters(spark):
    rng = np.random.default_rng(0)
    rows = clusters(rng, 8, 6, 32, 0.05)
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, []), (504, [0.0] * 32), (505, [None] * 32), (506, [math.nan] + [1.0] * 31),
             (507, [math.inf] * 32), (508, rows[0][1][:31]), (509, [x * 1e-200 for x in rows[0][1]]), (None, rows[0][1])]
    assert result(E.near_duplicates(frame(spark, rows))) == brute_force(rows, 0.95)
    assert E.near_duplicates(frame(spark, [])).collect() == []


def test_recall_and_precision(spark):
    rng = np.random.default_rng(1)
    rows = clusters(rng, 150, 14, 64, 0.15)
    want, got = brute_force(rows, 0.95), result(E.near_duplicates(frame(spark, rows)))
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())


def test_blocks_of_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = clusters(rng, 2, 70, 16, 0.02)
    assert result(E.near_duplicates(frame(spark, rows))) == brute_force(rows, 0.95)
