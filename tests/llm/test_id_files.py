"""Files of token ids: an exact round trip against the library, random access, and what must raise."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadscope.llm import id_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "Hello,  World", "don't WE'LL", "é É", "<|endoftext|> x<|startoftext|>", "日本語 🙂", "12 3456", "tab\tnew\nline", "x" * 300, "word " * 60_000]


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def want(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(ids(r[1]), "<u4").tobytes()))):
        own = ids(text)
        out.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def written(spark, rows, folder, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    df = df.withColumn("n_tokens", F.lit("clash")).withColumn("frame", F.lit(1)).withColumn("row", F.lit(None)).withColumn("file", F.lit(0))
    return id_files.write(df, PATH, folder, end_id=2, files=4)


def found(spark, folder):
    return sorted((tuple(r) for r in id_files.read(spark, folder).collect()), key=lambda r: r[1])


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = list(enumerate(ODD)) + [(100 + k, " ".join(rng.choices(["some", "Words", "of", "text,", "and", "more"], k=rng.randrange(80)))) for k in range(300)]
    rows += [(150, "again"), (150, "again"), (150, "other"), (None, "no id"), (None, "none either")] + [(7, "hot " * k) for k in range(40)]
    rng.shuffle(rows)
    folder = str(tmp_path / "out")
    manifest = written(spark, rows, folder)
    assert found(spark, folder) == want(rows)
    assert manifest.count() > 1 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    by_id = {}
    for doc_id, text in rows:
        by_id.setdefault(doc_id, []).append(ids(text))
    for doc_id in (0, 3, 7, 11, 150, 399):
        assert sorted(x.tolist() for x in id_files.fetch(folder, doc_id)) == sorted(by_id[doc_id])
    assert id_files.fetch(folder, 10_000) == [] == id_files.fetch(folder, -1)


@pytest.mark.parametrize("rows", [[], [(5, None)], [(None, "one")], [(1, "a"), (1, "a")]])
def test_small_tables(spark, tmp_path, rows):
    folder = str(tmp_path / "out")
    written(spark, rows, folder)
    assert found(spark, folder) == want(rows)


def test_reruns_agree_whatever_the_partitions(spark, tmp_path):
    rows = [(k % 20, f"text {k % 7}") for k in range(60)]
    for name, parts in (("a", 1), ("b", 5)):
        written(spark, rows, str(tmp_path / name), parts)
    assert found(spark, str(tmp_path / "a")) == found(spark, str(tmp_path / "b"))


def test_another_dictionary_raises(spark, tmp_path):
    folder = str(tmp_path / "out")
    written(spark, [(k, f"text of {k}") for k in range(50)], folder)
    name = next(x for x in os.listdir(folder) if x.startswith("dictionary-"))
    (tmp_path / "out" / name).write_bytes(b"something else")
    with pytest.raises(ValueError, match="another dictionary"):
        id_files.fetch(folder, 3)


def test_a_short_document_is_smaller_with_the_dictionary():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 49_000, 3).astype("<u2").tobytes() for _ in range(300)]
    texts = [b"".join(words[k] for k in rng.integers(0, 300, 60)) for _ in range(500)]
    shared = id_files._dictionary(texts[:400])
    size = lambda d: sum(len(id_files.zstandard.ZstdCompressor(level=3, dict_data=id_files._shared(d)).compress(t)) for t in texts[400:])
    assert size(shared) < 0.7 * size(b"")
