"""Hashed word shingles of whole texts, computed over Arrow buffers with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only. A word's hash is a
polynomial over its UTF-8 bytes taken from running sums, so a slice of many texts
is hashed without a loop over words. Slices hold about ``SLICE_BYTES`` bytes (one
text at least), which bounds the working memory for any batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _tables(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text in order, the sorted distinct hashes of its shingles of ``width`` words.

    A text with fewer words has its whole word sequence as its only shingle; a
    null text, or one without words, has the empty set.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        to = min(to, len(texts))
        bounds = (offsets[at : to + 1] - offsets[at]).astype(np.int64)
        hashes, first = _words(whole[offsets[at] : offsets[to]], bounds)
        runs = np.zeros(0, np.uint64)
        if len(hashes) >= width:
            runs = hashes[: len(hashes) - width + 1].copy()
            for k in range(1, width):
                runs = mixed(runs) + hashes[k : len(hashes) - width + 1 + k]
            runs = mixed(runs)
        for k in range(to - at):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                short = hashes[a : a + 1]
                for j in range(a + 1, b):
                    short = mixed(short) + hashes[j : j + 1]
                yield mixed(short + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
        at = to
