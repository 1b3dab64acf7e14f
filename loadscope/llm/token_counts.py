"""Token counts of whole texts by a compiled byte-pair transducer.

The merge list is compiled into a deterministic transducer: its states are the ids
of the vocabulary, and the transition ``u -> v`` that reads the bytes of ``v`` and emits
one token exists exactly when the merges leave ``u v`` as two tokens. Every prefix of
a word then has one run, so the run over the whole word gives the library's count.
Transitions are compiled when a corpus first asks for them and kept.

A position where white space follows something else ends a word whatever stood before
it. A chunk of a text is therefore a state map ``(head, count, tail)``: the open bytes
before its first such position, the tokens between the first and the last, and the
open bytes after it. Maps compose associatively; those of a text's chunks are
combined by a prefix scan in which neighbours meet in pairs, so a text can be cut anywhere.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 18
#: Cached words of a worker; a cache is emptied when it is full.
CACHE_WORDS = 500_000
#: Transitions and words kept of a long tail are bounded likewise.
CACHE_TRANSITIONS = 1_000_000

#: The word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space beyond ASCII, as UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SEGMENT = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_SYNC = re.compile(rb"[^\t-\r ][\t-\r ]")


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the vocabulary file to bytes: bytes that print stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        special = {t["content"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(symbols[c] for c in s)
        self.special = [s.encode() for s in special]
        self.bytes_of = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            self.rank[self.id_of[a], self.id_of[b]] = (k, self.id_of[a + b])
        self.parts = {new: pair for pair, (_, new) in self.rank.items()}
        # trie over the vocabulary: node * 256 + byte -> node; ends: node -> id
        self.next: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for b, i in self.id_of.items():
            if self.merged(b) != [i]:
                continue  # no run of the merges ends in this entry
            node = 0
            for c in b:
                step = self.next.get(node << 8 | c)
                if step is None:
                    step = self.next[node << 8 | c] = nodes
                    nodes += 1
                node = step
            self.ends[node] = i
        self.allowed: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """The merges applied in the order of their ranks."""
        ids = [self.id_of[bytes((b,))] for b in word]
        while len(ids) > 1:
            found = [(self.rank[p], p) for p in zip(ids, ids[1:], strict=False) if p in self.rank]
            if not found:
                break
            (_, new), pair = min(found)
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one edge of a token while it is merged, from its byte on, each with the rank of the merge that replaces it."""
        pieces, until = [], float("inf")
        while True:
            pieces.append((token, until))
            if token not in self.parts:
                return pieces[::-1]
            until = self.rank[self.parts[token]][0]
            token = self.parts[token][side]

    def _allows(self, u: int, v: int) -> bool:
        """Whether the merges leave ``u v`` as two tokens.

        A token's merge comes after those of its parts, so ranks order the events at
        the border: the piece on either side grows, or the two pieces there merge.
        """
        key = u << 20 | v
        found = self.allowed.get(key)
        if found is not None:
            return found
        left, right = self._edge(u, 1), self._edge(v, 0)
        i = j = 0
        found = True
        while i < len(left) and j < len(right):
            (a, until_a), (b, until_b) = left[i], right[j]
            across = self.rank.get((a, b))
            # of equal pairs in a row, the left one merges first
            if across is not None and across[0] < until_a and across[0] <= until_b:
                found = False
                break
            if until_a <= until_b:
                i += 1
            else:
                j += 1
        if len(self.allowed) >= CACHE_TRANSITIONS:
            self.allowed.clear()
        self.allowed[key] = found
        return found

    def count(self, word: bytes) -> int:
        """Tokens emitted by the run over ``word``: the longest transition first, back where none goes on.

        A position is reached by one run only, so one that leads nowhere is never entered again.
        """
        n, at, last = len(word), 0, -1
        step, ends, known = self.next.get, self.ends.get, self.allowed.get
        run: list[tuple[int, int, list[tuple[int, int]]]] = []
        closed: set[int] = set()
        while at < n:
            node, ways, i = 0, [], at
            while i < n:
                node = step(node << 8 | word[i])
                if node is None:
                    break
                i += 1
                v = ends(node)
                if v is not None:
                    ways.append((i, v))
            while True:
                going = None
                while ways:
                    to, v = ways.pop()
                    if to in closed:
                        continue
                    if last < 0:
                        going = v
                        break
                    fine = known(last << 20 | v)
                    if fine or (fine is None and self._allows(last, v)):
                        going = v
                        break
                if going is not None:
                    run.append((at, last, ways))
                    at, last = to, going
                    break
                closed.add(at)
                at, last, ways = run.pop()
        return len(run)


class StateMap(NamedTuple):
    """What a chunk does: ``count`` is None for a chunk without a position that ends a word."""

    head: bytes
    count: int | None
    tail: bytes


class Counter:
    """Tokens of a text; holds the caches of a worker."""

    def __init__(self, path: str):
        import regex

        self.transducer = Transducer(path)
        self.words = regex.compile(PATTERN)
        self.of_segment: dict[bytes, int] = {}
        self.of_word: dict[str, int] = {}
        special = self.transducer.special
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None

    def _segment(self, text: str) -> int:
        total = 0
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            # characters newer than the library are signs to it
            known = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in text)
            return sum(self.transducer.count(text[m.start() : m.end()].encode()) for m in self.words.finditer(known))
        for word in self.words.findall(text):
            n = self.of_word.get(word)
            if n is None:
                if len(self.of_word) >= CACHE_WORDS:
                    self.of_word.clear()
                n = self.of_word[word] = self.transducer.count(word.encode())
            total += n
        return total

    def _segments(self, text: bytes) -> int:
        """Tokens of bytes that begin and end at a word's end."""
        if _WIDE.search(text):
            return self._segment(text.decode())
        parts = _SEGMENT.findall(text)
        known = list(map(self.of_segment.get, parts))
        if None in known:
            if len(self.of_segment) >= CACHE_WORDS:
                self.of_segment.clear()
            for k, n in enumerate(known):
                if n is None:
                    known[k] = self.of_segment.get(parts[k])
                    if known[k] is None:
                        known[k] = self._segment(parts[k].decode())
                        if len(parts[k]) <= 64:
                            self.of_segment[parts[k]] = known[k]
        return sum(known)

    def map_of(self, chunk: bytes) -> StateMap:
        first = _SYNC.search(chunk)
        if first is None:
            return StateMap(chunk, None, b"")
        low = high = first.start() + 1
        # the last such position: white space after the last run of other bytes but one
        end = len(chunk.rstrip(b"\t\n\x0b\x0c\r "))
        if end < len(chunk) and end > low:
            high = end
        else:
            body = chunk[:end]
            cut = max(body.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            high = max(low, len(body[: cut + 1].rstrip(b"\t\n\x0b\x0c\r ")))
        return StateMap(chunk[:low], self._segments(chunk[low:high]) if high > low else 0, chunk[high:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two neighbouring chunks; a word may end where they meet, or stay open across them."""
        open_, total = (a.head, 0) if a.count is None else (a.tail, a.count)
        middle = self.map_of(open_ + b.head)
        if middle.count is None and b.count is None:
            return StateMap(middle.head, None, b"") if a.count is None else StateMap(a.head, a.count, middle.head)
        if middle.count is None:
            head = middle.head if a.count is None else a.head
            closed = 0 if a.count is None else self._closed(middle.head)
            return StateMap(head, total + closed + b.count, b.tail)
        head = middle.head if a.count is None else a.head
        total += middle.count + (0 if a.count is None else self._closed(middle.head))
        if b.count is None:
            return StateMap(head, total, middle.tail)
        return StateMap(head, total + self._closed(middle.tail) + b.count, b.tail)

    def _closed(self, part: bytes) -> int:
        return self._segments(part) if part else 0

    def _plain(self, text: bytes) -> int:
        if len(text) <= CHUNK or _WIDE.search(text):
            return self._closed(text)
        maps = [self.map_of(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = paired + maps[len(paired) * 2 :]
        whole = maps[0]
        return self._closed(whole.head) + (whole.count or 0) + self._closed(whole.tail)

    def count(self, text: bytes) -> int:
        if self.special is None or b"<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """One per worker and vocabulary: compiling takes about a second."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``path`` names a byte-level vocabulary file, which every executor must have; its
    special strings inside a text count as one token. Null and empty texts have none.
    Rows are counted each for itself; null ids stay null. Columns other than
    ``doc_id`` and ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Callable[[bytes], int] = _counter(path).count
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            tokens, sizes = [], []
            for at in range(0, len(texts), 512):
                for text in texts.slice(at, 512).to_pylist():
                    sizes.append(len(text or b""))
                    tokens.append(count(text) if text else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
