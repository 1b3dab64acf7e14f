"""Divergence of sources against a plain version over dense tables of shares."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loadscope.llm import source_divergence, words

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def want(rows, least, top=50):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in held.items() if n >= least]
        n = defaultdict(Counter)
        for _, source, terms in own:
            n[source].update(t for t in terms if held[t] >= least)
        total = sum(n.values(), Counter())

        def share(counts):
            whole = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // whole for t in kept}

        p, q = {s: share(n[s]) for s in n}, share(total)
        for s in p:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def found(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    df = df.withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("part", F.lit(None))
    return sorted(tuple(r) for r in source_divergence.audit(df, least_docs=least, **more).collect())


ODD = [
    (None, None, None), ("", "en", "a"), ("É é É Ünï\x00cödé a.b'c_d", "en", None), ("日本 語 " * 30, None, "ü"), ("x" * 100 + " y" * 5000, "en", "a"),
    ("only here", "lonely", "single"), ("12 34 --", "en", "numbers"),
]


@pytest.mark.parametrize("block", [1, 50, 10**6])
@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_like_dense_tables(spark, monkeypatch, block, size):
    rng = random.Random(block + size)
    vocabulary = ["Éa", "the", "The", "of", "and", "zu", "語", "éa", "q" * 20, "r" * 17, *(f"{a}{b}" for a in "abcd" for b in "xyz")]
    rows = ODD + [
        (" ".join(rng.choices(vocabulary, k=rng.randrange(30), weights=[1 + (hash_ * (k + 3)) % 7 for k in range(len(vocabulary))])), rng.choice(["en", "de"]), f"s{hash_}")
        for hash_ in [min(rng.randrange(9), rng.randrange(9)) for _ in range(120)]
    ]
    monkeypatch.setattr(words, "SLICE_BYTES", size)
    monkeypatch.setattr(source_divergence, "PAIRS", 7 if size == 300 else 1 << 20)
    monkeypatch.setattr(source_divergence, "SUMS", 3 if size == 300 else 10**6)
    assert found(spark, rows, 12, block=block) == want(rows, 12)


def test_top_terms_and_ties(spark):
    rows = [(" ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80)), "en", "a")] * 2 + [("other words", "en", "b")] * 2
    result = found(spark, rows, 2)
    assert result == want(rows, 2)
    assert sum(r[2] == "term" and r[1] == "a" for r in result) == 50


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("a b", "en", "x")], [("a b", "en", "x"), ("c", "en", "y")]])
def test_small_tables(spark, rows):
    assert found(spark, rows, 2) == want(rows, 2)


def test_shares_stay_exact(spark):
    for count, whole in ((0, 7), (9 * 10**14, 9 * 10**14 + 11), (123_456_789_012, 999_999_999_999_999), (2, 7)):
        row = spark.createDataFrame([(count, whole)], "n bigint, whole bigint").select(source_divergence._share("n", "whole", 5, 10**9)).first()
        assert row[0] == 1 + 10**9 * (count + 5) // whole
