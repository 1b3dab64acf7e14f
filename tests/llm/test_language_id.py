import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loadscope.llm import language_id as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = L.Pieces(PATH)


def all_ways(word, table):
    """Sum over every segmentation, by trying all cuts."""
    out = np.zeros(table.shape[1])
    for cuts in range(1 << (len(word) - 1)):
        at = [0, *[k + 1 for k in range(len(word) - 1) if cuts >> k & 1], len(word)]
        p = np.ones(table.shape[1])
        for i, j in zip(at, at[1:], strict=False):
            piece = PIECES.of.get(word[i:j])
            p = p * (table[piece] if piece is not None else table[-1] if j == i + 1 else 0.0)
        out += p
    return out


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    table = L._tables(rng.random((PIECES.size, 3)) / PIECES.size)
    words = ["a", "the", "größe", "thing", "señor", "日本語", "zzqx"]
    got = L.log_likelihood(PIECES, table, words)
    for w, g in zip(words, got, strict=True):
        assert np.allclose(g, np.log(all_ways("▁" + w, table)))


def test_expected_pieces_add_up():
    rng = np.random.default_rng(1)
    table = L._tables(rng.random((PIECES.size, 2)) / PIECES.size)
    words, n = ["thing", "other", "an"], np.array([3.0, 1.0, 2.0])
    total = L._expected(PIECES, table, words, np.array([0, 1, 0]), n)
    length = {k: len(p) for p, k in PIECES.of.items()}
    letters = sum(length.get(p, 1) * total[p].sum() for p in np.flatnonzero(total.sum(axis=1)))
    assert math.isclose(letters, sum(c * (len(w) + 1) for c, w in zip(n, words, strict=True)))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = L.identify(docs.withColumn("score", F.lit("clash")), PATH)
    both = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(both) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in both)
    hidden = [r for r in both if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in hidden) >= 0.97 * len(hidden)


def test_odd_rows(spark):
    rows = [(i, "the quick brown fox and the dog", "en", 1) for i in range(6)] + [(10 + i, "der schnelle braune fuchs und der hund", "de", 1) for i in range(6)]
    rows += [(20, None, "en", 1), (21, "", None, 1), (22, "12 %% __", "de", 1), (23, "the " * 30000, None, 1), (24, "²", "en", 1), (24, "²", "en", 1), (None, "und der hund", "de", 1), (25, "x" * 5000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, held_out int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df, PATH).collect()}
    assert [got[k][0] for k in (20, 21, 22, 24)] == ["und"] * 4 and got[20][1] == 0.0
    assert got[23][0] == "en" and got[None][0] == "de" and got[0][0] == "en" and got[25][0] in ("en", "de")
    assert L.identify(df.limit(0), PATH).collect() == []
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None).cast("string")), PATH).collect()} == {"und"}
