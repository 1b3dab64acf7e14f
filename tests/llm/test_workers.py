"""Memory of Python workers: small batches, small slices, freed memory given back."""

import re
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loadscope.llm import ngram_join, packing

REPO = Path(__file__).resolve().parents[2]

HELD = """
import re
from loadscope.llm.workers import tidied

pinned = []

def run(batches):
    blocks = [bytes(2000) for _ in range(100_000)]
    pinned.append(bytes(2000))  # the top of the heap stays in use
    yield from batches

def used():
    return sum(map(int, re.findall(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) // 1024

list(tidied(run)(iter([])))
before = used()
list(tidied(run)(iter([])))
print(used() - before, list(tidied(lambda batches: batches)(iter([1, 2]))))
list(run(iter([])))
print(used() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_task_gives_its_memory_back():
    out = subprocess.run([sys.executable, "-c", HELD], cwd=REPO, capture_output=True, text=True, check=True).stdout.split("\n")
    assert int(out[0].split()[0]) < 40 and out[0].endswith("[1, 2]")
    assert int(out[1]) > 100  # without it


def documents(n: int) -> pa.RecordBatch:
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 50, k % 40))) or None for k in range(n)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": texts})


def test_batches_of_points_and_sets_are_bounded(monkeypatch):
    monkeypatch.setattr(ngram_join, "POINTS_AT_ONCE", 64)
    monkeypatch.setattr(ngram_join, "SHINGLES_AT_ONCE", 1000)
    docs = documents(1000)
    points = list(ngram_join.point_batches(iter([docs, docs.slice(0, 0)]), 3, 90))
    assert max(len(b) for b in points) == 64
    sets = list(ngram_join.set_batches(iter([docs, docs.slice(0, 0)]), 3))
    assert 10 < len(sets) < 40 and max(len(b.column("shingles").flatten()) for b in sets) < 1040
    points, sets = pa.Table.from_batches(points).to_pylist(), pa.Table.from_batches(sets).to_pylist()
    assert [r["doc_id"] for r in points] == [r["doc_id"] for r in sets] == list(range(1000))
    assert [r["n_shingles"] for r in points] == [len(r["shingles"]) for r in sets]


def test_working_memory_of_a_packed_slice():
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 99, 1500)))
    texts = pa.array([text] * (8_000_000 // len(text)))
    tracemalloc.start()
    try:
        n = sum(len(x) for x in ids.texts(texts))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert n and peak < 400, peak
