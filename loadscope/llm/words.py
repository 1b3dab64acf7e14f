"""Slices of texts and their distinct words, found with numpy over Arrow buffers.

A slice holds about ``SLICE_BYTES`` bytes of whole texts (one text at least), so the
working memory follows neither the batch nor the corpus, and nothing outlives a
slice. Equal words are found by exact keys: words of up to 16 bytes are two 64-bit
numbers and a length, longer ones go through a dictionary. Work that depends on a
word alone is then done once for each distinct word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 23
#: ASCII white space.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_HEAD = 8
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(_HEAD + 1)], dtype=np.uint64)


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, bytes, bounds)``: texts ``row`` and following lie between the bounds; null counts as empty."""
    most = most or SLICE_BYTES
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
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, len(texts))
        yield at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for 256 entries of one byte; as an index, numpy would take eight bytes for every one."""
    return np.frombuffer(bytearray(data.tobytes().translate(table.tobytes())), dtype=table.dtype)


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes that no bound crosses, and the runs before each bound."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    other = np.ones(n + 1, dtype=bool)
    np.logical_or(edge[1:n], ~inside[: n - 1], out=other[1:n])
    starts = np.flatnonzero(inside & other[:n])
    np.logical_or(edge[1:n], ~inside[1:], out=other[1:n])
    ends = np.flatnonzero(inside & other[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _eight(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to eight bytes from every place, as little-endian numbers."""
    every = np.ndarray(shape=(len(data) - _HEAD + 1,), dtype="<u8", buffer=data, strides=(1,))
    return every[at] & _KEEP[np.clip(length, 0, _HEAD)]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words given by their places: one word of each kind, and the kind of every word."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(2 * _HEAD, np.uint8)])
    low = _eight(padded, starts, lengths)
    high = _eight(padded, np.minimum(starts + _HEAD, len(data)), lengths - _HEAD)
    long = np.flatnonzero(lengths > 2 * _HEAD)
    if len(long):
        raw, number = data.tobytes(), {}
        low[long] = [number.setdefault(raw[a:b], len(number)) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        high[long] = 0
    kind = np.minimum(lengths, 2 * _HEAD + 1).astype(np.uint8)  # lengths tell words with zero bytes, and long words, apart
    del padded, lengths, long  # a slice has more than a million words
    mixed = kind * np.uint64(0xD6E8FEB86659FD93)
    mixed += high
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= low * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed, kind="stable")
    low = low[order]  # one after another
    high = high[order]
    kind = kind[order]
    mixed = mixed[order]
    if _clash(low, high, kind, mixed):  # two words under one number: order by the words themselves
        by_word = np.lexsort((kind, high, low))
        order, low, high, kind = order[by_word], low[by_word], high[by_word], kind[by_word]
    new = np.ones(n, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (kind[1:] != kind[:-1])
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _clash(low: np.ndarray, high: np.ndarray, kind: np.ndarray, mixed: np.ndarray) -> bool:
    same = mixed[1:] == mixed[:-1]
    return bool((same & ((low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (kind[1:] != kind[:-1]))).any())


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``sizes[0]`` places, then those of the next range."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)
