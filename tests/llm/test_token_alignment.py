"""Alignment of two tokenizers against a plain version that walks over the bytes of every text."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadscope.llm import token_alignment, words

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATH_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
SYMBOLS = token_alignment.byte_symbols()

ODD = [
    None, "", " ", "   ", "\n\n", "Hello,  World", " lead", "trail  ", "a▁b", "<|endoftext|> <s></s>", "日本語 🙂🙃 ok", "é é é", "no  break　wide", "x   y",
    "12 3456\t7\r\n8", "x" * 300, "a\x00b \x01", "﻿bom", "\U000e0041 tag", "ab " * 9000, "", "\x85 nel\x1c fs",
]


def tokens(text):
    """Ids and bytes of both sides, or None."""
    if not text:
        return None
    a = [(k, bytes(SYMBOLS[c] for c in t)) for k, t in zip(*(lambda e: (e.ids, e.tokens))(A.encode(" " + text, add_special_tokens=False)))]
    b = [(k, bytes([int(p[3:5], 16)]) if B.is_byte(k) else p.replace("▁", " ").encode()) for k, p in zip(B.encode(text), B.encode(text, return_type=str))]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def groups(text):
    both = tokens(text)
    if both is None:
        return []
    out, (a, b) = [], map(list, both)
    while a:
        left, right, at, to = [a[0][0]], [b[0][0]], len(a.pop(0)[1]), len(b.pop(0)[1])
        while at != to:
            if at < to:
                left.append(a[0][0])
                at += len(a.pop(0)[1])
            else:
                right.append(b[0][0])
                to += len(b.pop(0)[1])
        out.append((left, right))
    return out


def want(rows):
    per_row = [groups(t) for _, t in rows]
    links = [[(x, y) for left, right in g for x in left for y in right] for g in per_row]
    count = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), g, own in zip(rows, per_row, links):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own),
            hashlib.sha256(line.encode()).hexdigest() if line else "",
        ))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in token_alignment.align(df, PATH_A, PATH_B).collect()), key=repr)


ALIGNER = token_alignment.Aligner(PATH_A, PATH_B)
BITS = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\xa0", "　", " ", "\x1c", "\x85", ";", "\r", "the", "Tion", "'s", "ll", "9", "**", ".", "é", "é", "🙂", "語", "▁", "<s>", "<|endoftext|>", "\x00", ""])


def test_the_vocabularies_fall_into_units():
    assert ALIGNER.b.opens[ord(" ")] and ALIGNER.b.opens[ord("\n")] and not ALIGNER.b.opens[ord("\r")] and not ALIGNER.b.opens[ord("a")]


@settings(max_examples=400, deadline=None)
@given(st.lists(BITS, max_size=20).map("".join) | st.text(max_size=30))
def test_one_text_like_the_libraries(text):
    import numpy as np

    data = b"" if not text or "▁" in text else (" " + text).encode()
    rows = list(token_alignment._rows(ALIGNER, 0, [1], np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])))
    own = want([(1, text)])[0]
    assert rows[0][2:8] == (*own[:5], own[7])


@pytest.mark.parametrize("size", [1, 1 << 10, 1 << 23])
def test_counts_over_slices_and_partitions(spark, monkeypatch, size):
    rng = random.Random(size)
    some = [" ".join(rng.choices(["the", "thation", "über", "Mañana,", "of", "x\ny", "日本", "don't"], k=rng.randrange(1, 40))) for _ in range(60)]
    rows = list(enumerate(ODD)) + [(100 + k, t) for k, t in enumerate(some)] + [(3, "again the"), (3, "again the"), (None, "no id")]
    monkeypatch.setattr(words, "SLICE_BYTES", size)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("slice", F.lit("clash")).withColumn("count", F.lit(1)).withColumn("code", F.lit(None))
    assert found(df) == want(rows)


def test_groups_without_cuts_are_counted_by_ids(monkeypatch):
    monkeypatch.setattr(token_alignment, "_LARGE", 0)
    text = "日本語 🙂🙃🙂🙂 naïve thationing"
    units = ALIGNER.align([(" " + text).encode()])
    links = Counter(x << 16 | y for left, right in groups(text) for x in left for y in right)
    assert dict(zip(units.codes[units.pair].tolist(), units.times.tolist())) == links


def test_memory_of_a_slice():
    """What a slice takes beside its text is bounded: links are several times the units, and are counted by blocks of documents."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 14))) for _ in range(3000)]
    texts = [(" " + " ".join(rng.choices(vocabulary, k=200))).encode() for _ in range(1500)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    tracemalloc.start()
    n = sum(1 for _ in token_alignment._rows(ALIGNER, 0, list(range(len(texts))), data, bounds))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) + 1 and peak < 16 * len(data)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []
    assert found(spark.createDataFrame([(1, None)], "doc_id bigint, text string")) == [(1, 0, 0, 0, 0, 0, 0, "")]
