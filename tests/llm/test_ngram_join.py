import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscope.llm import ngram_join

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_force(rows, width, percent):
    """doc_id -> (set size, smallest document reachable by links)."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.pop(at), lambda: words.insert(at, f"n{rng.random()}"), lambda: words.__setitem__(at, "x")])()
    return " ".join(words)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for n in (1, 2, 3, 4, 9, 11, 12, 13, 14, 20, 25, 30, 40, 60, 61, 80, 120, 121, 250, 400):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for edits in (0, 0, 0, 1, 1, 2, 2, 3, 4, n // 40, n // 20, n // 10):
            rows.append((i := i + 1, family(rng, base, edits if n > 8 else 0)))
    rows += [(9000, None), (9001, ""), (9002, " \t "), (9003, "W1 w2"), (9004, "w1  W2"), (9005, "w2 w1")]
    rng.shuffle(rows)
    assert result(ngram_join.similar(documents(spark, rows), width, percent)) == brute_force(rows, width, percent)


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, family(rng, base, rng.choice([0, 1, 2, 3, 4]))) for k in range(250)]
    assert result(ngram_join.similar(documents(spark, rows), 3, 90)) == brute_force(rows, 3, 90)


def test_low_similarity_families_do_not_join(spark):
    rng = random.Random(5)
    line = [f"s{k}" for k in range(60)]
    rows = [(k, " ".join([f"u{k}_{j}" for j in range(20)] + line)) for k in range(80)]
    assert result(ngram_join.similar(documents(spark, rows), 3, 90)) == brute_force(rows, 3, 90)


def test_pairs_just_below_the_threshold_are_not_verified(spark, monkeypatch):
    """Texts of 60 common and 8 own words, similarity 0.78: coordinate minima alone let most of their pairs through."""
    rng = random.Random(11)
    line = [f"s{k}" for k in range(60)]
    rows = [(k, " ".join(line + [f"u{k}_{j}" for j in range(8)])) for k in range(60)]
    rows += [(1000 + k, family(rng, [f"t{j}" for j in range(80)], 3)) for k in range(40)]
    asked, linked = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, *a: asked.append(pairs.distinct().count()) or linked(pairs, *a))
    assert result(ngram_join.similar(documents(spark, rows), 5, 80)) == brute_force(rows, 5, 80)
    assert sum(asked) < 400


def test_bound_of_two_points():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (1, 9, 60, 60, 200, 200)]

    def point(s, groups):
        at = ngram_join.mixed(s) % np.uint64(groups)
        content = np.bincount(at.astype(int), weights=ngram_join.mixed(s + np.uint64(7)) >> np.uint64(56), minlength=groups).astype(int) & 255
        return ngram_join.unpacked(ngram_join.packed(np.bincount(at.astype(int), minlength=groups), content))

    for a in sets:
        for b in sets:
            x, y = ngram_join.folded(point(a, 256), 128), point(b, 128)
            most = ngram_join.most_common(x[None], y)[0]
            assert len(np.intersect1d(a, b)) <= most <= np.minimum(x[0], y[0]).sum()


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)]
    df = documents(spark, rows).withColumn("component_id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(df, 3, 90).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, None)], key=str)
    assert ngram_join.similar(documents(spark, []), 3, 90).collect() == []


def test_groups_cover_the_largest_difference():
    for percent in (80, 90):
        for c in range(1, 22):
            low, high = ngram_join._class_start(c), ngram_join._class_start(c + 1) - 1
            partner = high * 100 // percent
            most = 0
            for a in {low, (low + high) // 2, high}:
                for b in range(a, a * 100 // percent + 1):
                    # an overlap o is enough when 100 o >= percent (a + b - o)
                    o = -(-percent * (a + b) // (100 + percent))
                    if o <= a:
                        most = max(most, a + b - 2 * o)
            differ, groups = ngram_join._class_layout(c, percent)
            assert partner >= high and groups > differ >= most
