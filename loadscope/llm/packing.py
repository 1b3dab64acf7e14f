"""Packing documents into windows by lexical retrieval.

Documents are tokenized once. Whole windows of a long document are sequences of their
own; what is left of every document goes to a shard. A shard holds an inverted
index of its documents with BM25 weights, whose document frequencies and mean length
are those of the whole corpus. The longest unused document is the seed of a window,
and its unused neighbours fill the window in the order of their scores: those that fit
whole first, then the best one that is left is cut to the room. The last window of
a shard is cut into sequences whose lengths are powers of two, so nothing is padded.

Shards have about ``SHARD_TOKENS`` tokens and a document less than one window in
its shard, which bounds the memory of a task. Documents are dealt by their lexical key,
the two rarest terms that other documents have too: documents of one
first term go to one shard, terms that are larger than a shard are cut by the second
one, and only pairs of terms that are larger still by a hash of the row. Related documents and
copies thus meet however many shards there are; neighbours that share neither term may not.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm import words
from loadscope.llm.token_counts import byte_symbols
from loadscope.llm.words import BLANK, distinct, looked_up, ranges, slices, spans
from loadscope.llm.workers import tidied
from loadscope.session import write_table

WINDOW = 2048
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75
#: A task forgets the parts of words from before the last slices when it knows more.
KNOWN_PARTS = 200_000
#: Parts in one list for the library.
_PARTS_AT_ONCE = 10_000
#: Ids of the vocabulary are below this.
VOCABULARY = 1 << 16

_PARTS = "kind int, doc_id bigint, uid bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_WHOLE, _REST, _COUNTS = 0, 1, 2


#: The vocabulary's words, in either case.
_PARTS_OF_WORD = r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


#: Blank, letter, digit, sign: a digit is a part of its own, the others are runs.
_KIND = np.where(BLANK, 0, 3).astype(np.uint8)
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts_in(kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one kind that no bound crosses."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(n + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[:n] |= kind == 2
    change[bounds] = True
    return np.flatnonzero(change[:n] & (kind > 0)), np.flatnonzero(change[1:] & (kind > 0)) + 1


def _rare(words: list[bytes]) -> np.ndarray:
    """Words left whole to the library: classes of new characters differ between its parts and ours.

    These are words with letters from U+0580 on, combining marks of U+0300-U+037F, the
    letter U+0130, or the sign that begins a special string.
    """
    data = np.frombuffer(b" ".join(words) + b"  ", dtype=np.uint8)
    odd = (data >= 0xD6) | (data == 0xCC) | (data == 0xCD)
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    lengths = np.array([len(w) for w in words]) + 1
    seen = np.concatenate([[0], np.cumsum(odd)])
    stop = np.cumsum(lengths)
    return seen[stop] > seen[stop - lengths]


class WordIds:
    """Token ids of whole texts by the library, once for each distinct word of half a slice; made anew by every task.

    The vocabulary drops white space and never joins words across it, so words between
    ASCII blanks are independent. Words are cut into parts, runs of letters or signs,
    and the parts that the last slices did not have go to the library's model in one
    list. Words that normalisation could change across parts, that may hold a special
    string or have rarer letters go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.split = regex.compile(" |" + _PARTS_OF_WORD).findall
        self.symbols = str.maketrans({chr(b): c for c, b in byte_symbols().items() if b != 0x20})
        self.last = np.zeros(VOCABULARY, dtype=bool)  # ids that end a part: one for each part
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids_of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct lower-case parts; parts of one slice at least, and of at most two, are remembered."""
        if len(self.parts) > KNOWN_PARTS:
            self.parts, self.older = {}, self.parts
        known, older = self.parts, self.older
        found = list(map(known.get, parts))
        if older:
            found = [x or older.get(p) for p, x in zip(parts, found, strict=True)]
        new = [p for p, x in zip(parts, found, strict=True) if x is None]
        if new:
            mapped = " ".join(new).encode().decode("latin-1").translate(self.symbols).split(" ")
            lists = [mapped[at : at + _PARTS_AT_ONCE] for at in range(0, len(mapped), _PARTS_AT_ONCE)]
            at = 0
            for some, got in zip(lists, self.model.encode_batch_fast(lists, is_pretokenized=True, add_special_tokens=False), strict=True):
                row = np.array(got.ids, dtype="<u2")
                stop = (np.flatnonzero(self.last[row]) + 1) * 2
                ids, low = row.tobytes(), 0
                for part, high in zip(new[at : at + len(some)], stop.tolist(), strict=True):
                    known[part] = ids[low:high]
                    low = high
                at += len(some)
            found = [x or known[p] for p, x in zip(parts, found, strict=True)]
        return found

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        rare = _rare(words)
        text = b" ".join([w for w, odd in zip(words, rare.tolist(), strict=True) if not odd]).decode()
        if not unicodedata.is_normalized("NFC", text):
            rare |= [not unicodedata.is_normalized("NFC", w.decode()) for w in words]
            text = b" ".join([w for w, odd in zip(words, rare.tolist(), strict=True) if not odd]).decode()
        common, other = np.flatnonzero(~rare), np.flatnonzero(rare)
        parts = self.split(text.replace("\u03a3", "\u03c3").lower())  # a capital sigma's lower case depends on its place
        number: dict[str, int] = {" ": 0}
        at = np.array([number.setdefault(p, len(number)) for p in parts], dtype=np.int64)
        blobs = [b"", *self._ids_of_parts(list(number)[1:])]
        ids = np.frombuffer(b"".join(blobs), dtype="<u2")
        sizes = np.array([len(x) for x in blobs], dtype=np.int64) // 2
        whole = [np.array(self.tokenizer.encode(words[k].decode(), add_special_tokens=False).ids, dtype=np.uint16) for k in other.tolist()]
        counts = np.zeros(len(words), dtype=np.int64)
        if len(common):
            counts[common] = np.bincount(np.cumsum(at == 0), weights=sizes[at], minlength=len(common)).astype(np.int64)
        counts[other] = [len(x) for x in whole]
        row = np.concatenate([ids[ranges((np.cumsum(sizes) - sizes)[at], sizes[at])], *whole])
        if not len(other):
            return row, counts
        order = np.concatenate([common, other])
        start = np.empty(len(words), dtype=np.int64)  # where a word's ids lie in that row
        start[order] = np.cumsum(counts[order]) - counts[order]
        return row[ranges(start, counts)], counts

    def of_slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in a row, and the ids before each text.

        ASCII words are cut into parts in place; words with an apostrophe, with a special
        string's sign or with other letters are cut by the pattern.
        """
        kind = looked_up(_KIND, data)
        starts, ends, _ = spans(kind > 0, bounds)
        strange = (data >= 0x80) | (data == 0x27)
        strange[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        odd = np.flatnonzero(np.logical_or.reduceat(strange, starts)) if len(starts) else starts
        if len(odd):
            mark = np.zeros(len(data) + 1, dtype=np.int8)
            mark[starts[odd]] = 1
            np.add.at(mark, ends[odd], -1)
            kind[np.cumsum(mark[:-1], dtype=np.int8) > 0] = 0
        low, high = _parts_in(kind, bounds)
        small = looked_up(_LOWER, data)
        one, of_part = distinct(small, low, high)
        raw = small.tobytes().decode("latin-1")
        blobs = self._ids_of_parts([raw[a:b] for a, b in zip(low[one].tolist(), high[one].tolist(), strict=True)])
        sizes = np.array(list(map(len, blobs)), dtype=np.int64) // 2
        ids = np.frombuffer(b"".join(blobs), dtype="<u2")
        first, size, place = (np.cumsum(sizes) - sizes)[of_part], sizes[of_part], low
        if len(odd):
            at, to = starts[odd], ends[odd]
            one, of_word = distinct(data, at, to)
            raw = data.tobytes()
            more, counts = self.of_words([raw[a:b] for a, b in zip(at[one].tolist(), to[one].tolist(), strict=True)])
            place = np.concatenate([low, at])
            order = np.argsort(place, kind="stable")
            first = np.concatenate([first, (len(ids) + np.cumsum(counts) - counts)[of_word]])[order]
            size, place, ids = np.concatenate([size, counts[of_word]])[order], place[order], np.concatenate([ids, more])
        stops = np.concatenate([[0], np.cumsum(size)])
        return ids[ranges(first, size)], stops[np.searchsorted(place, bounds)]

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in order; a null text has none."""
        for _, data, bounds in slices(texts, max(1, words.SLICE_BYTES // 2)):
            ids, at = self.of_slice(data, bounds)
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[low:high]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _tokenized(docs: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """Whole windows as pieces, the rest of every document with its ids, and each task's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u2")
        documents = sequences = 0
        counts = np.zeros(VOCABULARY, dtype=np.int64)
        place = np.zeros(VOCABULARY, dtype=np.int64)  # of an id's last occurrence in a document
        for batch in batches:
            found = ids_of.texts(batch.column("text"))
            for at in range(0, len(batch), 256):
                rows = []
                for doc_id in batch.column("doc_id").slice(at, 256).to_pylist():
                    ids = np.concatenate([next(found), end])
                    at_id, every = ids.astype(np.int64), np.arange(len(ids))
                    place[at_id] = every
                    counts[at_id[place[at_id] == every]] += 1
                    uid = (task << 40) + documents
                    documents += 1
                    whole = len(ids) // window * window
                    for start in range(0, whole, window):
                        number = (1 << 62) + (task << 36) + sequences
                        sequences += 1
                        rows.append((_WHOLE, doc_id, uid, start, window, _crc(ids[start : start + window]), len(ids), number, 0, None))
                    if whole < len(ids):
                        rows.append((_REST, doc_id, uid, whole, len(ids) - whole, None, len(ids), None, None, ids[whole:].tobytes()))
                yield _columns(rows, _PARTS)
        used = np.flatnonzero(counts)
        yield _columns([(_COUNTS, None, None, documents, len(used), None, None, None, None, np.concatenate([used, counts[used]]).astype("<i8").tobytes())], _PARTS)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), _PARTS)


def _frequencies(parts: DataFrame) -> np.ndarray:
    """Document frequency of every id: at most ``VOCABULARY`` numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                both = np.frombuffer(blob, dtype="<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["token", "n"])

    out = np.zeros(VOCABULARY)
    for token, n in parts.where(f"kind = {_COUNTS}").select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


class _Index:
    """BM25 postings of one shard: for every id, documents and weights."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        lengths = np.array([len(x) for x in ids])
        owner = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
        key, tf = np.unique(owner * VOCABULARY + np.concatenate(ids).astype(np.int64), return_counts=True)
        doc, token = key // VOCABULARY, key % VOCABULARY
        self.first = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.token = token
        weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        order = np.argsort(token, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(token[order], np.arange(VOCABULARY + 1))
        self.n = len(ids)

    def scores(self, seed: int) -> np.ndarray:
        terms = self.token[self.first[seed] : self.first[seed + 1]]
        low, sizes = self.at[terms], self.at[terms + 1] - self.at[terms]
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[rows], weights=self.weight[rows], minlength=self.n)

    def keep(self, open_: np.ndarray) -> None:
        """Leave out the postings of all other documents."""
        held = open_[self.doc]
        before = np.concatenate(([0], np.cumsum(held)))
        self.doc, self.weight, self.at = self.doc[held], self.weight[held], before[self.at]


def fill_windows(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(document, from, length)`` that hold every id once."""
    index = _Index(ids, idf, mean)
    left = np.array([len(x) for x in ids], dtype=np.int64)
    taken = np.zeros(len(ids), dtype=np.int64)
    sequences = []
    by_length = np.argsort(-left, kind="stable")
    at, indexed = 0, len(ids)

    def take(doc: int, most: int) -> tuple[int, int, int]:
        n = int(min(left[doc], most))
        piece = (doc, int(taken[doc]), n)
        taken[doc] += n
        left[doc] -= n
        return piece

    while True:
        while at < len(by_length) and not left[by_length[at]]:
            at += 1
        if at == len(by_length):
            break
        seed = int(by_length[at])
        pieces = [take(seed, window)]
        room = window - pieces[0][2]
        if room:
            open_ = np.flatnonzero(left)
            if 2 * len(open_) < indexed:
                index.keep(left > 0)
                indexed = len(open_)
            scores = index.scores(seed)[open_]
        while room and len(open_):
            fits = np.flatnonzero(left[open_] <= room)
            best = int(fits[np.argmax(scores[fits])] if len(fits) else np.argmax(scores))
            pieces.append(take(int(open_[best]), room))
            room -= pieces[-1][2]
            rest = left[open_] > 0
            open_, scores = open_[rest], scores[rest]
        if not room:
            sequences.append(pieces)
            continue
        while pieces:  # the last window: lengths that are powers of two
            total = sum(p[2] for p in pieces)
            size, part = 1 << (total.bit_length() - 1), []
            while size:
                doc, start, n = pieces.pop(0)
                part.append((doc, start, min(n, size)))
                if n > size:
                    pieces.insert(0, (doc, start + size, n - size))
                size -= part[-1][2]
            sequences.append(part)
    return sequences


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _keyed(rest: DataFrame, frequency: np.ndarray) -> DataFrame:
    """Rests with their lexical key: the two rarest terms that more than one document has, by one order for all documents.

    Terms within a factor of eight count as equally rare and are ordered by a hash: else
    the key would be the term that fewest of a group of related documents share.
    """
    rare = np.where(frequency > 1, np.floor(np.log2(np.maximum(frequency, 2)) / 3), np.inf)
    rank = np.empty(VOCABULARY, dtype=np.int64)
    rank[np.lexsort((_mixed(np.arange(1, VOCABULARY + 1)), rare))] = np.arange(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty((2, len(batch)), dtype=np.int64)
            for k, blob in enumerate(batch.column("ids").to_pylist()):
                ranks = rank[np.frombuffer(blob, dtype="<u2")]
                keys[:, k] = first = ranks.min()
                if len(others := ranks[ranks > first]):
                    keys[1, k] = others.min()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[0]), pa.array(keys[1])], [*batch.schema.names, "first", "second"])

    names = "doc_id bigint, uid bigint, start bigint, doc_tokens bigint, ids binary"
    return rest.select("doc_id", "uid", "start", "doc_tokens", "ids").mapInArrow(tidied(run), f"{names}, first bigint, second bigint")


def _dealt(keyed: DataFrame, shard_tokens: int) -> DataFrame:
    """Rests with their shard. Sums of the first terms, at most ``VOCABULARY``, and the pairs larger than a shard reach the driver."""
    pairs = write_table(keyed.groupBy("first", "second").agg(F.sum(F.length("ids") / 2).cast("long").alias("n")), "pairs")
    light = np.zeros(VOCABULARY, dtype=np.int64)
    for first, n in pairs.where(F.col("n") <= shard_tokens).groupBy("first").agg(F.sum("n")).collect():
        light[first] = n
    large = sorted((f * VOCABULARY + s, n) for f, s, n in pairs.where(F.col("n") > shard_tokens).collect())
    split = light > shard_tokens
    ends = np.cumsum(np.where(split, 0, light))
    base = (ends - np.where(split, 0, light)) // shard_tokens
    parts = np.where(split, -(-light // shard_tokens), 1)
    at = int(base.max()) + 1
    blocks = np.cumsum(np.where(split, parts, 0))
    base = np.where(split, at + blocks - parts, base)
    at += int(blocks[-1])
    codes = np.array([c for c, _ in large] + [1 << 40], dtype=np.int64)
    cuts = np.array([-(-n // shard_tokens) for _, n in large] + [1], dtype=np.int64)
    from_ = at + np.cumsum(cuts) - cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, uid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "uid"))
            shard = base[first] + (_mixed(second) % parts[first].astype(np.uint64)).astype(np.int64)
            code = first * VOCABULARY + second
            k = np.searchsorted(codes, code)
            shard = np.where(codes[k] == code, from_[k] + (_mixed(uid) % cuts[k].astype(np.uint64)).astype(np.int64), shard)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "uid", "start", "doc_tokens", "ids")), pa.array(shard)], ["doc_id", "uid", "start", "doc_tokens", "ids", "shard"])

    return keyed.mapInArrow(tidied(run), "doc_id bigint, uid bigint, start bigint, doc_tokens bigint, ids binary, shard bigint")


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``path`` names the vocabulary file, which every executor must have. A null text
    counts as empty: its only id is ``end_id``. Rows that repeat a ``doc_id`` are
    packed each for itself, and null ids stay null. An empty table gives no rows.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    parts = write_table(_tokenized(docs, path, end_id, window), "tokens")
    frequency = _frequencies(parts)
    rest = parts.where(f"kind = {_REST}")
    documents = parts.where(f"kind = {_COUNTS}").agg(F.sum("start")).first()[0] or 0
    tokens, count = rest.agg(F.sum("length"), F.count("*")).first()
    idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
    mean = (tokens or 1) / max(1, count)

    def fill(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        ids = [np.frombuffer(x, dtype="<u2") for x in group.column("ids").to_pylist()]
        doc_id, start, whole = (group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        rows = []
        for k, pieces in enumerate(fill_windows(ids, idf, mean, window)):
            offset = 0
            for doc, low, n in pieces:
                rows.append((doc_id[doc], start[doc] + low, n, _crc(ids[doc][low : low + n]), whole[doc], (key[0].as_py() << 32) + k, offset))
                offset += n
        return pa.Table.from_batches([_columns(rows, PIECES)])

    dealt = _dealt(write_table(_keyed(rest, frequency), "keyed"), shard_tokens)
    filled = dealt.groupBy("shard").applyInArrow(fill, PIECES)
    names = [f.split()[0] for f in PIECES.split(", ")]
    return parts.where(f"kind = {_WHOLE}").select(*names).unionByName(filled)
