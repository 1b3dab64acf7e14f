"""Alignment of two tokenizers' tokens over the same text, and how often ids are linked.

Both tokenizers see a text with one blank before it. Places where a token of either
ends cut the text into groups, the least pieces that both write whole; every token of
one side is linked with every token of the other side of its group.

The libraries' spans are the coarse cuts: character offsets of the one, spans of the
other's pieces in its protocol message. They can't say where a token ends inside a
character, so tokens that share a character and byte-fallback pieces are placed by
the bytes they decode to. A batch whose decoded bytes are not its text is done again
unit by unit, and a document with such a unit has no tokens.

Neither tokenizer joins white space to what stands before it (but for the signs that
pieces of the vocabulary tell), so a text falls into units, white space and the word
behind it, that are aligned once for all texts of a slice. Texts with other white space than ASCII's are one unit.

A slice (twice `words.SLICE_BYTES` of text, or one longer text) leaves one row per document,
which units it holds and how often, and one row for the slice: its id pairs, the
documents that hold each, and the pairs of each unit. Pairs are summed over the
corpus by joins and aggregations; each slice gets back the counts of its own pairs only.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadscope.llm import words
from loadscope.llm.token_counts import byte_symbols
from loadscope.llm.words import BLANK, distinct, ranges
from loadscope.session import write_table

#: Units of one call of the libraries, in bytes.
BATCH_BYTES = 1 << 16
#: Units of the documents of a slice whose links are counted together.
BLOCK_UNITS = 1 << 16
#: Links of a group beyond this are counted by distinct ids, so a group without cuts stays small.
_LARGE = 1 << 12
_FIRST = b" a"
#: White space of the byte-level pattern beyond ASCII's.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MARK = "▁"

_DOC, _SLICE = 0, 1
_PARTS = (
    "kind int, slice bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "first binary, second binary, third binary, fourth binary, fifth binary"
)
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all entries in a row, where each begins, and its length."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


class Side:
    """Ids and byte ends of the tokens of a text that begins with a blank."""

    table: tuple[np.ndarray, np.ndarray, np.ndarray]

    def exact(self, text: bytes, ids: np.ndarray) -> bool:
        """Whether the ids' decoded bytes are the text."""
        flat, first, sizes = self.table
        own = sizes[ids]
        return int(own.sum()) == len(text) and bool((flat[ranges(first[ids], own)] == np.frombuffer(text, dtype=np.uint8)).all())


class ByteSide(Side):
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = byte_symbols()
        entries = [b""] * self.tokenizer.get_vocab_size()
        for token, k in self.tokenizer.get_vocab().items():
            entries[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.table = _flat(entries)

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for text, found in zip(texts, self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=np.int64)
            ends = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 1]
            if not text.isascii():
                data = np.frombuffer(text, dtype=np.uint8)
                ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]  # characters to bytes
                inside = np.zeros(len(ids), dtype=bool)
                inside[:-1] = ends[:-1] >= ends[1:]  # the next token ends in the same character
                ends[inside] = np.cumsum(self.table[2][ids])[inside]
            out.append((ids, ends))
        return out


class PieceSide(Side):
    """A sentencepiece vocabulary that adds the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(k) for k in range(n)]
        self.fallback = np.array([self.model.is_byte(k) for k in range(n)])
        self.table = _flat([bytes([int(p[3:5], 16)]) if b else p.replace(_MARK, " ").encode() for p, b in zip(pieces, self.fallback, strict=True)])
        #: white space that no piece holds behind another character
        self.opens = BLANK.copy()
        inner = {ord(" " if c == _MARK else c) for p in pieces for c in re.findall(f"(?<=[^{_MARK} \\t-\\r])[{_MARK} \\t-\\r]", p)}
        self.opens[list(inner)] = False

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for text in texts:
            found = self.model.encode(text[1:].decode(), return_type="proto").pieces
            pairs = np.array([(p.id, p.end) for p in found], dtype=np.int64).reshape(-1, 2)
            ids, ends = pairs[:, 0], pairs[:, 1] + 1
            fallback = self.fallback[ids]
            if fallback.any():  # spans of whole characters
                ends[fallback] = np.cumsum(self.table[2][ids])[fallback]
            out.append((ids, ends))
        return out


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _flat([str(k).encode() for k in range(n)])


class Aligner:
    """Units of a slice: their tokens, groups and links."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.numbers = _decimals(max(len(self.a.table[2]), len(self.b.table[2])))

    def _batches(self, units: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """Numbers and bytes of units that are tokenized together; units that end in white space are alone."""
        some, size = [], 0
        for k in sorted(range(len(units)), key=units.__getitem__):  # neighbours use the same parts of the vocabulary
            unit = units[k]
            if BLANK[unit[-1]] or _WIDE.search(unit):
                yield [k], [unit]
                continue
            some.append(k)
            size += len(unit)
            if size > BATCH_BYTES:
                yield some, [units[i] for i in some]
                some, size = [], 0
        if some:
            yield some, [units[i] for i in some]

    def align(self, units: list[bytes]) -> Units:
        out = Units(len(units))
        batches = list(self._batches(units))
        for at in range(0, len(batches), 16):
            some = batches[at : at + 16]
            texts = [_FIRST + b"".join(u) for _, u in some]
            for (numbers, own), text, a, b in zip(some, texts, self.a.tokens(texts), self.b.tokens(texts), strict=True):
                self._batch(out, numbers, own, text, a, b)
        return out.closed()

    def _batch(self, out: Units, numbers: list[int], units: list[bytes], text: bytes, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> None:
        if not (self.a.exact(text, a[0]) and self.b.exact(text, b[0])):
            if len(units) == 1:
                out.bad[numbers[0]] = True
                return
            for number, unit in zip(numbers, units, strict=True):
                one = [_FIRST + unit]
                self._batch(out, [number], [unit], one[0], self.a.tokens(one)[0], self.b.tokens(one)[0])
            return
        (ids_a, ends_a), (ids_b, ends_b) = a, b
        keep_a, keep_b = ends_a > len(_FIRST), ends_b > len(_FIRST)
        ids_a, ends_a, ids_b, ends_b = ids_a[keep_a], ends_a[keep_a], ids_b[keep_b], ends_b[keep_b]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        stops = len(_FIRST) + np.cumsum([len(u) for u in units])
        own = np.array(numbers, dtype=np.int64)
        unit = own[np.searchsorted(stops, cuts)]  # of every group
        out.n_a += np.bincount(unit[group_a], minlength=out.n)
        out.n_b += np.bincount(unit[group_b], minlength=out.n)
        out.n_groups += np.bincount(unit, minlength=out.n)
        np.add.at(out.n_links, unit, n_a * n_b)
        first_b = np.cumsum(n_b) - n_b
        large = n_a * n_b > _LARGE
        small = ~large[group_a]
        sizes = n_b[group_a[small]]
        partner = ids_b[ranges(first_b[group_a[small]], sizes)]
        out.add(np.repeat(unit[group_a[small]], sizes), np.repeat(ids_a[small], sizes) << 16 | partner, None)
        for g in np.flatnonzero(large):
            left, times_left = np.unique(ids_a[group_a == g], return_counts=True)
            right, times_right = np.unique(ids_b[group_b == g], return_counts=True)
            codes = (left[:, None] << 16 | right[None, :]).ravel()
            out.add(np.full(len(codes), unit[g]), codes, (times_left[:, None] * times_right[None, :]).ravel())
        self._texts(out, own, unit, ids_a, ids_b, group_a, group_b, n_a, n_b)

    def _texts(self, out: Units, own, unit, ids_a, ids_b, group_a, group_b, n_a, n_b) -> None:
        """``a1,a2|b1;`` for all groups in a row, cut at the units."""
        flat, first, sizes = self.numbers
        before = np.cumsum(n_a + n_b) - n_a - n_b
        ids = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        sign = np.full(len(ids), ord(","), dtype=np.uint8)
        ids[before[group_a] + np.arange(len(ids_a)) - (np.cumsum(n_a) - n_a)[group_a]] = ids_a
        ids[before[group_b] + n_a[group_b] + np.arange(len(ids_b)) - (np.cumsum(n_b) - n_b)[group_b]] = ids_b
        sign[before + n_a - 1] = ord("|")
        sign[before + n_a + n_b - 1] = ord(";")
        long = sizes[ids]
        stop = np.cumsum(long + 1)
        line = np.empty(int(stop[-1]), dtype=np.uint8)
        line[stop - 1] = sign
        line[ranges(stop - 1 - long, long)] = flat[ranges(first[ids], long)]
        raw = line.tobytes()
        last = np.append(np.flatnonzero(unit[1:] != unit[:-1]), len(unit) - 1)
        low = 0
        for number, high in zip(unit[last].tolist(), stop[before[last] + n_a[last] + n_b[last] - 1].tolist(), strict=True):
            out.text[number] = raw[low:high]
            low = high


class Units:
    """What is known of each distinct unit of a slice."""

    def __init__(self, n: int):
        self.n = n
        self.bad = np.zeros(n, dtype=bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, dtype=np.int64) for _ in range(4))
        self.text = [b""] * n
        self._links: list[tuple[np.ndarray, np.ndarray]] = []
        self._many: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, unit: np.ndarray, codes: np.ndarray, times: np.ndarray | None) -> None:
        unit, codes = unit.astype(np.int32), codes.astype(np.uint32)  # ids are below 1 << 16
        if times is None:
            self._links.append((unit, codes))
        else:
            self._many.append((unit, codes, times))

    def closed(self) -> Units:
        """Links by unit: distinct pairs of the slice, and for every unit its pairs and how often it holds each."""
        every = [*self._links, *((u, c) for u, c, _ in self._many), (np.zeros(0, np.int32), np.zeros(0, np.uint32))]
        self.codes = np.unique(np.concatenate([np.unique(c) for _, c in every]))
        n = max(1, len(self.codes))
        key = np.concatenate([u.astype(np.int64) * n + np.searchsorted(self.codes, c) for u, c in every])
        single = sum(len(c) for _, c in self._links)
        self._links = []
        if self._many:
            times = np.concatenate([np.ones(single, dtype=np.int64), *(t for _, _, t in self._many)])
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, self.times = key[first], np.add.reduceat(times, first)
            self._many = []
        else:
            key, self.times = np.unique(key, return_counts=True)
        self.pair = (key % n).astype(np.int32)
        self.pairs_of = np.bincount(key // n, minlength=self.n)
        return self


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def _units(data: np.ndarray, bounds: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units; every text that is not empty begins with a blank."""
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[1:-1] = words.looked_up(opens, data[1:]) & ~words.looked_up(BLANK, data[:-1])
    for k in {int(np.searchsorted(bounds, m.start(), side="right")) - 1 for m in _WIDE.finditer(data.tobytes())}:
        begin[bounds[k] : bounds[k + 1]] = False
    begin[bounds] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.append(starts[1:], len(data))


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    names, kinds = zip(*(f.split() for f in _PARTS.split(", ")), strict=True)
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for given in batches:
            texts = given.column("text").cast(pa.large_string())
            whole = pc.and_kleene(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, _MARK)))
            texts = pc.if_else(whole, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), pa.scalar(None, pa.large_string()))
            ids = given.column("doc_id").to_pylist()
            for row, data, bounds in words.slices(texts, 2 * words.SLICE_BYTES):
                yield batch(list(_rows(aligner, number, ids[row : row + len(bounds) - 1], data, bounds)))
                number += 1

    return docs.select("doc_id", "text").mapInArrow(run, _PARTS)


def _rows(aligner: Aligner, number: int, ids: list[int | None], data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
    starts, ends = _units(data, bounds, aligner.b.opens)
    one, kind = distinct(data, starts, ends)
    raw = data.tobytes()
    distinct_units = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
    before = np.searchsorted(starts, bounds)
    kind = kind.astype(np.int32)
    del raw, starts, ends, one
    units = aligner.align(distinct_units)
    bad = np.concatenate([[0], np.cumsum(units.bad[kind])])
    good = bad[before[1:]] == bad[before[:-1]]
    totals = []
    for values in (units.n_a, units.n_b, units.n_groups, units.n_links):
        sums = np.concatenate([[0], np.cumsum(values[kind])])
        totals.append(np.where(good, sums[before[1:]] - sums[before[:-1]], 0).tolist())
    first = np.cumsum(units.pairs_of) - units.pairs_of
    n_pairs = max(1, len(units.codes))
    docs_of_pair = np.zeros(len(units.codes), dtype=np.int64)
    text, low = units.text, 0
    while low < len(ids):  # some documents at a time: their links are several times their units
        high = max(low + 1, int(np.searchsorted(before, before[low] + BLOCK_UNITS, side="right")) - 1)
        doc = np.repeat(np.arange(high - low), np.diff(before[low : high + 1]))
        held = good[low:high][doc]
        key, times = np.unique(doc[held] * max(1, units.n) + kind[before[low] : before[high]][held], return_counts=True)
        doc, unit = key // max(1, units.n), key % max(1, units.n)
        sizes = units.pairs_of[unit]
        linked = np.unique(np.repeat(doc, sizes) * n_pairs + units.pair[ranges(first[unit], sizes)])
        docs_of_pair += np.bincount(linked % n_pairs, minlength=len(units.codes))
        places = np.searchsorted(doc, np.arange(high - low + 1))
        for k in range(low, high):
            sha = ""
            if good[k] and before[k + 1] > before[k]:
                sha = hashlib.sha256(b"".join([text[i] for i in kind[before[k] : before[k + 1]].tolist()])[:-1]).hexdigest()
            own = slice(places[k - low], places[k - low + 1])
            yield (_DOC, number, ids[k], *(t[k] for t in totals), sha, _bytes(unit[own]), _bytes(times[own]), None, None, None)
        low = high
    blobs = (units.codes, docs_of_pair, units.pairs_of, units.pair, units.times)
    yield (_SLICE, number, *([None] * 6), *map(_bytes, blobs))


def _pairs(parts: DataFrame) -> DataFrame:
    """One row for each slice and pair: the documents of the slice that hold it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, codes, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "first", "second")), strict=True):
                codes, n = _numbers(codes), _numbers(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), number)), pa.array(codes), pa.array(n[: len(codes)])], ["slice", "code", "n"])

    rows = parts.where(F.col("kind") == _SLICE).select("slice", "first", "second")
    return rows.mapInArrow(run, "slice bigint, code bigint, n bigint").where("n > 0")


def link_counts(parts: DataFrame) -> DataFrame:
    """``code, count, best``: documents that hold a pair linked, and whether no pair of its first id has more.

    A first id has at most as many pairs as the second vocabulary has ids, whatever the corpus.
    """
    of_first = W.partitionBy(F.shiftright("code", 16))
    counts = _pairs(parts).groupBy("code").agg(F.sum("n").alias("count"))
    return counts.select("code", "count", (F.col("count") == F.max("count").over(of_first)).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, ``path_b`` one of
    sentencepiece; every executor must have both. Null and empty texts, and texts that a
    side does not give back byte for byte, have no tokens: zeros and an empty hash, and
    they count for no pair. Rows that repeat a ``doc_id`` are documents of their own, and
    null ids stay null. A very long text is a slice of its own, in one task. An empty table
    gives no rows. Columns other than ``doc_id`` and ``text`` are not read, whatever they
    are called.
    """
    parts = write_table(_aligned(docs, path_a, path_b), "aligned")
    counts = write_table(link_counts(parts), "link_counts")
    known = _pairs(parts).select("slice", "code").join(counts, "code")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table, known: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        own = rows.take(pa.array(np.flatnonzero(kind == _SLICE))).to_pylist()[0]
        codes, _, pairs_of, pair, times = (_numbers(own[c]) for c in ("first", "second", "third", "fourth", "fifth"))
        count, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        at = np.searchsorted(codes, known.column("code").to_numpy())
        count[at] = known.column("count").to_numpy()
        best[at] = known.column("best").to_numpy(zero_copy_only=False)
        stop = np.cumsum(pairs_of)
        of_unit = []
        for values in (times * best[pair], times * count[pair]):
            sums = np.concatenate([[0], np.cumsum(values)])
            of_unit.append(sums[stop] - sums[stop - pairs_of])
        docs = rows.filter(pa.array(kind == _DOC))
        n_best, count_sum = [], []
        for units, often in zip(docs.column("first").to_pylist(), docs.column("second").to_pylist(), strict=True):
            units, often = _numbers(units), _numbers(often)
            n_best.append(int((of_unit[0][units] * often).sum()))
            count_sum.append(int((of_unit[1][units] * often).sum()))
        more = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([more[c] if c in more else docs.column(c) for c in names], names=names)

    return parts.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(finish, RESULT)
