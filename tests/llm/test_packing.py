import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadscope.llm import packing, words

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
IDS = packing.WordIds(PATH)

ODD = [
    None, "", " ", "Hello,  World", "don't WE'LL", "a\x1cb c", "é É", "<|endoftext|> x<|startoftext|>", "日本語 🙂", "ΣΑΣ Σ",
    "12 3456", "tab\tnew\nline", " wide　space", "x" * 300, "word " * 5000,
]


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


WORDS = st.sampled_from([" ", "\n", "\x1c", "\xa0", "a", "Tion", "e\u0301", "\u0130", "'S", "'ll", "'", "\u017f", "9", "\u0663", "**", ".", "\u3042", "<|endoftext|>", "<|", "\u212b", "\u03a3"])


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=25).map("".join) | st.text(max_size=40))
def test_ids_like_the_library(text):
    (found,) = IDS.texts(pa.array([text]))
    assert found.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_many_texts_and_slices(monkeypatch):
    rng = random.Random(5)
    some = [None, "", "one two", "é<|endoftext|>x y", "a\x00 a a\x00b", "w" * 40 + " " + "w" * 40] + ["".join(rng.choices(["ab", "Ab,", " ", "é", "\n", "x" * 17], k=30)) for _ in range(60)]
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in some]
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(words, "SLICE_BYTES", size)
        assert [x.tolist() for x in packing.WordIds(PATH).texts(pa.array(some, pa.string()))] == want


def texts(n):
    rng = random.Random(n)
    topics = [[chr(base + k) * 2 for k in range(30)] for base in (0x430, 0x3AC, 0x5D0, 0x4E00, 0xAC00, 0x3042)]
    return [" ".join(rng.choice(rng.choice(topics) if rng.random() < 0.1 else topics[i % 6]) for _ in range(rng.randrange(1, 220))) for i in range(n)]


def check(pieces, rows, window):
    """Every id of every document lies in one piece, sequences have no gap, and none is padded."""
    by_row, sequences = {}, {}
    for p in pieces:
        by_row.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(ids(t))
    assert set(by_row) == set(want)
    for i, own in by_row.items():
        for whole in want[i][:1]:
            copies = len(want[i])
            seen = np.zeros(len(whole), int)
            for p in own:
                part = whole[p.start : p.start + p.length]
                assert p.doc_tokens == len(whole) and len(part) == p.length > 0
                assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
                seen[p.start : p.start + p.length] += 1
            assert (seen == copies).all()
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_round_trip_of_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(900, "again and again"), (900, "again and again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("uid", F.lit("clash")).withColumn("start", F.lit(-1))
    check(packing.pack(df, PATH, window=64, shard_tokens=500).collect(), rows, 64)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_windows_are_full_and_hold_related_documents(spark):
    rows = list(enumerate(texts(400)))
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, window=512, shard_tokens=1 << 15).collect()
    check(pieces, rows, 512)
    together = {}
    for p in pieces:
        together.setdefault(p.sequence_id, []).append(p.doc_id % 6)
    same = sum(sum(1 for x in t[1:] if x == t[0]) for t in together.values())
    assert same > 0.5 * sum(len(t) - 1 for t in together.values())


def test_reruns_agree(spark):
    df = spark.createDataFrame(list(enumerate(texts(150))), "doc_id bigint, text string").coalesce(1)
    run = lambda: sorted(map(tuple, packing.pack(df, PATH, window=256, shard_tokens=4000).collect()))
    assert run() == run()


def test_scores_are_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint16) for _ in range(30)]
    idf, mean = rng.random(packing.VOCABULARY), 17.0
    index = packing._Index(docs, idf, mean)
    for seed in range(30):
        want = np.zeros(30)
        for t in set(docs[seed].tolist()):
            for k, d in enumerate(docs):
                tf = int((d == t).sum())
                want[k] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
        assert np.allclose(index.scores(seed), want)


def test_used_documents_leave_the_index(monkeypatch):
    """Scores of open documents stay, the postings of used ones go: a window costs what is left."""
    rng = np.random.default_rng(8)
    ids = [rng.integers(0, 300, n).astype("<u2") for n in rng.integers(1, 400, 120)]
    idf, window = rng.random(packing.VOCABULARY), 512
    index = packing._Index(ids, idf, 100.0)
    want, open_ = index.scores(5), np.arange(len(ids)) % 3 == 0
    index.keep(open_)
    got = index.scores(5)
    assert (got[open_] == want[open_]).all() and not got[~open_].any()
    sizes, scores = [], packing._Index.scores
    monkeypatch.setattr(packing._Index, "scores", lambda self, seed: sizes.append(len(self.doc)) or scores(self, seed))
    held = [np.zeros(len(x), int) for x in ids]
    for pieces in packing.fill_windows(ids, idf, 100.0, window):
        for doc, start, n in pieces:
            held[doc][start : start + n] += 1
    assert all((h == 1).all() for h in held) and sizes[-1] < sizes[0] / 4


def test_related_documents_meet_at_any_number_of_shards(spark):
    rng = random.Random(3)
    terms = rng.sample(sorted(w[:-4] for w in LIBRARY.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha() and len(w) > 9), 760)
    common, rows = terms[:40], []
    for g in range(60):
        own = terms[40 + 12 * g : 52 + 12 * g]
        rows += [(g * 4 + k, " ".join(rng.choice(own if rng.random() < 0.5 else common) for _ in range(63))) for k in range(4)]  # four fill a window
    rows += [(1000 + k, "the very same text " * 15 + "again and again") for k in range(80)]  # a key larger than a shard
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for shard_tokens in (1 << 19, 16_000, 3_000):
        pieces = packing.pack(df, PATH, window=256, shard_tokens=shard_tokens).collect()
        check(pieces, rows, 256)
        groups = {}
        for p in pieces:
            groups.setdefault(p.sequence_id, []).append((p.doc_id // 4, p.doc_id))
        met = {d for t in groups.values() for g, d in t if d < 1000 and any(h == g and e != d for h, e in t)}
        assert len(met) > 0.6 * 240
