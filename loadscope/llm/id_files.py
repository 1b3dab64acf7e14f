"""Token ids as binary files with a shared zstandard dictionary.

Every document's ids are an array of little-endian 16-bit numbers (32-bit ones for
larger vocabularies), compressed by itself with one dictionary that is trained on
the arrays of a bounded sample. A short document can so be read alone, and still
shares what it has in common with the others.

A folder holds

* ``dictionary-<sha256>``, the dictionary's bytes under their hash;
* ``ids-<number>``, one file for each range of ids, in ascending order;
* ``manifest``, a Parquet table with one row per file: its number and name, documents
  and ids, the ids before it in the whole folder, and its first and last ``doc_id``.

A file is a head (``MAGIC``, bytes of an id, the dictionary's hash), the compressed
arrays one after another, and an index: ``doc_id``, whether it is null, place and
number of ids of every document, then its own length. Everything is little-endian.

Documents are tokenized and compressed once into a table, which a range partitioning
by ``doc_id`` and checksum sorts: rows that repeat a ``doc_id`` are cut like any
others. Tasks write with pyarrow's file systems under a name of their own and rename
at the end, so a lost or repeated task leaves whole files only.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadscope.llm.packing import WordIds
from loadscope.llm.sampling import first_by_hash
from loadscope.session import write_table

MAGIC = b"LSIDS\x01"
#: The dictionary is trained on at most so many documents of at most so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 1 << 16
DICTIONARY_BYTES = 1 << 16
LEVEL = 3

_HEAD, _TAIL = "<6sB32s", "<QQ6s"
_HEAD_BYTES, _TAIL_BYTES = struct.calcsize(_HEAD), struct.calcsize(_TAIL)
_INDEX = [("doc_id", "<i8"), ("known", "u1"), ("place", "<u8"), ("n", "<u8")]
_PACKED = "doc_id bigint, n_tokens bigint, crc bigint, row bigint, frame binary"
_FILES = "number bigint, file string, n_docs bigint, n_tokens bigint, low bigint, high bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _storage(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address, and the folder there; a bare path is a shared mount."""
    return pafs.FileSystem.from_uri(folder)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary; samples too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[-DICTIONARY_BYTES:]


def _shared(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _encoded(docs: DataFrame, path: str, end_id: int, kind: str, dictionary: bytes | None) -> DataFrame:
    """Every document's ids, compressed if there is a dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        end = np.array([end_id], dtype=kind)
        pack = bytes
        if dictionary is not None:
            pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary)).compress
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of.texts(batch.column("text")), strict=True):
                ids = np.concatenate([ids.astype(kind), end])
                rows.append((doc_id, len(ids), _crc(ids), row, pack(ids.tobytes())))
                row += 1
                size += len(rows[-1][4])
                if size > 1 << 23:
                    yield _batch(rows, _PACKED)
                    rows, size = [], 0
            yield _batch(rows, _PACKED)

    return docs.select("doc_id", "text").mapInArrow(run, _PACKED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    types = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names)


def write(docs: DataFrame, path: str, folder: str, end_id: int, files: int | None = None) -> DataFrame:
    """Write the ids of all documents to ``folder`` and return its manifest.

    ``path`` names the vocabulary file, which every executor must have; ``folder`` is a
    shared one. Documents lie in ascending order of ``doc_id``, null first; rows that
    repeat a ``doc_id`` are ordered by their ids' checksum and number, and each is kept.
    A null or empty text has the end id only. A long text is compressed like any other, in
    one task. ``files`` sets their number; without it they follow the session's shuffle
    partitions and their sizes. An empty table gives a folder with an empty manifest. Columns other than
    ``doc_id`` and ``text`` are not read, whatever they are called.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(WordIds(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select("doc_id", "text")
    sample = first_by_hash(rows.where(F.octet_length("text") <= SAMPLE_BYTES), "doc_id", SAMPLE_ROWS)
    dictionary = _dictionary([r.frame for r in _encoded(sample, path, end_id, kind, None).select("frame").collect()])
    digest = hashlib.sha256(dictionary).digest()
    fs, root = _storage(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)
    width = int(kind[2])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _storage(folder)
        number = TaskContext.get().partitionId()
        name = f"ids-{number:08d}"
        own = f"{root}/.{name}-{uuid.uuid4().hex}"
        index: list[np.ndarray] = []
        at = _HEAD_BYTES
        out = None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                out = fs.open_output_stream(own)
                out.write(struct.pack(_HEAD, MAGIC, width, digest))
            frames = batch.column("frame").to_pylist()
            part = np.zeros(len(batch), dtype=_INDEX)
            part["known"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            part["doc_id"] = batch.column("doc_id").fill_null(0).to_numpy()
            sizes = np.array([len(x) for x in frames], dtype=np.uint64)
            part["place"] = np.uint64(at) + np.cumsum(sizes) - sizes
            part["n"] = batch.column("n_tokens").to_numpy()
            index.append(part)
            out.write(b"".join(frames))
            at += int(sizes.sum())
        if out is None:
            return
        whole = np.concatenate(index)
        out.write(whole.tobytes())
        out.write(struct.pack(_TAIL, at, len(whole), MAGIC))
        out.close()
        fs.move(own, f"{root}/{name}")
        known = whole["doc_id"][whole["known"] == 1]
        low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        yield _batch([(number, name, len(whole), int(whole["n"].sum()), low, high)], _FILES)

    packed = write_table(_encoded(rows, path, end_id, kind, dictionary), "frames")
    key = ["doc_id", "crc", "n_tokens", "row"]
    cut = packed.repartitionByRange(*([files] if files else []), *key).sortWithinPartitions(*key)
    stored = write_table(cut.select("doc_id", "n_tokens", "frame").mapInArrow(store, _FILES), "files")
    before = W.orderBy("number").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    manifest = stored.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class Reader:
    """One file of a folder: its index, and the ids of any document by its place in the file."""

    def __init__(self, folder: str, file: str):
        fs, root = _storage(folder)
        self.file = fs.open_input_file(f"{root}/{file}")
        magic, self.width, digest = struct.unpack(_HEAD, self.file.read_at(_HEAD_BYTES, 0))
        size = self.file.size()
        self.end, n, last = struct.unpack(_TAIL, self.file.read_at(_TAIL_BYTES, size - _TAIL_BYTES))
        if magic != MAGIC or last != MAGIC:
            raise ValueError(f"{file} is not a whole file of token ids")
        with fs.open_input_stream(f"{root}/dictionary-{digest.hex()}") as given:
            dictionary = given.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{file} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(size - _TAIL_BYTES - self.end, self.end), dtype=_INDEX)
        if len(self.index) != n:
            raise ValueError(f"{file} has a broken index")
        self.decompress = zstandard.ZstdDecompressor(dict_data=_shared(dictionary)).decompress

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        ids = np.frombuffer(self.decompress(frame), dtype=f"<u{self.width}")
        if len(ids) != n:
            raise ValueError("a document has another number of ids than its index says")
        return ids

    def ids(self, k: int) -> np.ndarray:
        """The ids of the document at place ``k``; nothing else is read."""
        place = int(self.index["place"][k])
        stop = int(self.index["place"][k + 1]) if k + 1 < len(self.index) else self.end
        return self._ids(self.file.read_at(stop - place, place), int(self.index["n"][k]))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, read some megabytes at a time."""
        places = np.append(self.index["place"], np.uint64(self.end)).astype(np.int64)
        at = 0
        while at < len(self.index):
            to = max(at + 1, int(np.searchsorted(places, places[at] + (1 << 22), side="right")) - 1)
            block = self.file.read_at(int(places[to] - places[at]), int(places[at]))
            for k in range(at, to):
                row = self.index[k]
                frame = block[places[k] - places[at] : places[k + 1] - places[at]]
                yield int(row["doc_id"]) if row["known"] else None, self._ids(frame, int(row["n"]))
            at = to


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone; ``start`` counts the ids before it."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("number", "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                for doc_id, ids in Reader(folder, file):
                    rows.append((doc_id, start, len(ids), _crc(ids)))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows, DOCUMENTS)
                        rows = []
                yield _batch(rows, DOCUMENTS)

    files = manifest.repartitionByRange(max(1, manifest.count()), "number")
    return files.mapInArrow(run, DOCUMENTS)


def fetch(folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, once for every row that has this ``doc_id``; reads an index and these documents only."""
    fs, root = _storage(folder)
    files = pq.read_table(f"{root}/manifest", filesystem=fs, filters=[("low", "<=", doc_id), ("high", ">=", doc_id)])
    found = []
    for file in files.sort_by("number").column("file").to_pylist():
        reader = Reader(folder, file)
        known = reader.index["known"] == 1
        first = int(np.argmax(known))  # null ids come first
        low, high = (int(np.searchsorted(reader.index["doc_id"][first:], doc_id, side=s)) for s in ("left", "right"))
        found += [reader.ids(first + k) for k in range(low, high)]
    return found
