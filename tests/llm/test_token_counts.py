import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadscope.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = T.Counter(PATH)

ODD = [
    "", " ", "\n", "a", "hello world", "don't we'll I'd 'sx ''t", "  two  spaces\n\n tab\t", "a  b    c", "a\x1c b\x1f", " x 　 y",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "1234567 12.5 x2y", "ééé ñandú größe", "日本語のテキスト です", "🙂🙃 🙂",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "==== ---- ####", "x" * 5000, " " * 300 + "x", "\n" * 50, "á è", "\u0000\u0001 z", ":\U000323b0 x\U000323b0",
]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTER.count(text.encode()) == library(text)


PIECES = st.sampled_from([" ", "  ", "\n", "\t", " ", "the", "ing", "'s", "'", "é", "ß", "12", "-", "%%%", "Tion", "日", "🙂", "<|endoftext|>", "ab", "A", "."])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join) | st.text(max_size=60))
def test_like_the_library(text):
    assert COUNTER.count(text.encode()) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(1, 17))
def test_chunk_maps_compose_at_any_cut(text, size):
    before, T.CHUNK = T.CHUNK, size
    try:
        assert COUNTER.count(text.encode()) == library(text)
    finally:
        T.CHUNK = before


def test_words_of_merges():
    rng = random.Random(1)
    tokens = [b for b in COUNTER.transducer.bytes_of.values() if 0 < len(b) < 9]
    for _ in range(3000):
        word = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5)))
        assert COUNTER.transducer.count(word) == len(COUNTER.transducer.merged(word))
    ids = [COUNTER.transducer.id_of[b] for b in tokens]
    for _ in range(3000):
        u, v = rng.choice(ids[:3000]), rng.choice(ids[:3000])
        joined = COUNTER.transducer.bytes_of[u] + COUNTER.transducer.bytes_of[v]
        assert COUNTER.transducer._allows(u, v) == (COUNTER.transducer.merged(joined) == [u, v])


def test_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (7000, None), (7001, "again"), (7001, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, T.token_counts(df, PATH, limit=20).collect()), key=str)
    want = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 20) for i, t in rows]
    assert got == sorted(want, key=str)
    assert T.token_counts(df.limit(0), PATH).collect() == []
