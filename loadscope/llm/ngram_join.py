"""N-gram Jaccard join over count vectors of hashed shingle groups.

Every document is a point: its distinct shingles are hashed into groups and the
coordinates are the group counts. The overlap of two documents is at most the sum
of their coordinate minima, and that of a document with a node at most the sum of
the minima with the node's box. A point also holds a byte of each group's content: groups of
equal counts and different bytes have one shingle less in common.

The leaves of the index follow from the group counts by the pigeonhole rule. Two
sets of similarity ``t`` differ in at most ``d = (1 - t) |union|`` shingles; with
``d + 1`` groups, at least one group is the same in both, count and content. A
leaf is therefore one group with one content. Sizes fall into classes (ratio
``CLASS_RATIO``), each with its own number of groups; a document that may have
partners in the class below is indexed there too. With ``d + 1 + s`` groups, ``s + 1``
agree; if these are all empty, both documents have more than ``s`` empty groups.
Such documents, few by the choice of ``s``, also enter leaves of single shingles
(the first ``d + 1`` by hash). No pair is lost.

Inside a leaf no list of pairs is made. Members are first compared with the leaf's
smallest document, and those that link join its component. Only then do members
of different components meet, block by block: a document is tested against the
box of a block, then against its points, and what survives is verified. A document's likeliest
partner in a block comes first; only leaves where a document has more are gone through again.

All equalities are those of 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadscope.llm.components import connected_components
from loadscope.llm.exact_dedup import perhaps
from loadscope.llm.shingles import mixed, shingle_sets
from loadscope.llm.workers import tidied
from loadscope.session import write_table

CLASS_RATIO = 1.5
#: Least coordinates of a point; a set has about one for every two shingles.
COORDINATES = 64
#: Documents in a block of a leaf; two blocks are compared in one task.
BLOCK = 256
#: Documents in a batch of points, and shingles in a batch of sets (one document at least).
POINTS_AT_ONCE = 512
SHINGLES_AT_ONCE = 1 << 17

_POINTS = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, leaves array<bigint>, point binary"


def _bound(size: int, percent: int) -> int:
    """Most shingles in which a set of ``size`` can differ from a partner."""
    return (size * 100 // percent) * (100 - percent) // 100


def size_class(size: int) -> int:
    return int(math.log(size) / math.log(CLASS_RATIO) + 1e-9)


def _class_start(c: int) -> int:
    n = max(1, int(CLASS_RATIO**c) - 1)
    while size_class(n) < c:
        n += 1
    return n


def _class_layout(c: int, percent: int) -> tuple[int, int]:
    """Shingles that a pair can differ in whose smaller set is of the class, and the groups of the class.

    One group more than the differences would do; the others allow for the empty
    groups of all but a few sets.
    """
    differ = _bound(_class_start(c + 1) - 1, percent)
    groups = differ + 1
    while True:
        empty = groups * math.exp(-_class_start(c) / groups)
        spare = math.ceil(empty + 4 * math.sqrt(empty)) if differ else 0
        if groups >= differ + 1 + min(spare, differ):
            return differ, groups
        groups += 1


def coordinates(size: int) -> int:
    """Groups of a point: a power of two that grows with the set, so that the bound stays sharp for long texts."""
    return max(COORDINATES, 1 << (size // 2).bit_length())


def packed(counts: np.ndarray, content: np.ndarray) -> bytes:
    """A point: its counts in as few bytes as the largest needs, then a byte of content for each; the first byte is the width."""
    width = 1 if counts.max(initial=0) < 256 else 4
    return bytes((width,)) + counts.astype(f"<u{width}").tobytes() + content.astype(np.uint8).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Counts and contents, in two rows."""
    groups = (len(data) - 1) // (data[0] + 1)
    counts = np.frombuffer(data, dtype=f"<u{data[0]}", offset=1, count=groups)
    return np.array([counts, np.frombuffer(data, dtype=np.uint8, offset=1 + data[0] * groups)], dtype=np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups: a coordinate is the hash modulo the number of groups, so the parts add up."""
    if point.shape[1] == groups:
        return point
    point = point.reshape(2, -1, groups).sum(axis=1)
    point[1] &= 255
    return point


def most_common(some: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Most shingles that each of some points (along the first axis) can have in common with a point of as many groups."""
    counts, own = some[:, 0], point[0]
    fewer = (counts == own) & (some[:, 1] != point[1])
    return np.minimum(counts, own).sum(axis=1, dtype=np.int64) - fewer.sum(axis=1)


@cache
def _classes(size: int, percent: int) -> list[tuple[int, int, int]]:
    """``(class, differ, groups)`` of the classes that index a set."""
    c = size_class(size)
    both = [c] if not c or size * percent > 100 * (_class_start(c) - 1) else [c, c - 1]
    return [(k, *_class_layout(k, percent)) for k in both]


def leaves(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Leaf keys of one sorted distinct set."""
    n = len(shingles)
    if n == 0:
        return np.zeros(0, np.uint64)
    found = []
    bodies = mixed(shingles)
    for k, differ, groups in _classes(n, percent):
        # groups are ranges of the hash, so they are contiguous in the sorted set
        at = ((shingles >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        counts = np.diff(np.append(first, n)).astype(np.uint64)
        content = np.add.reduceat(bodies, first)
        tag = mixed(at[first] + np.uint64(k << 40))
        found.append(mixed(mixed(content + tag) + counts))
        if groups - len(first) >= groups - differ:
            found.append(mixed(shingles[: differ + 1] ^ mixed(np.array([k + 1], np.uint64))))
    return np.concatenate(found)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts).view(np.int64), pa.int64()))


def point_batches(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Points of ``doc_id, text``, at most ``POINTS_AT_ONCE`` in a batch whatever the batches that come."""
    for batch in batches:
        ids, sets = batch.column("doc_id").cast(pa.int64()), shingle_sets(batch.column("text"), width)
        for low in range(0, len(batch), POINTS_AT_ONCE):
            size, one, two, keys, vectors = [], [], [], [], []
            for s in islice(sets, POINTS_AT_ONCE):
                size.append(len(s))
                m = mixed(s)
                one.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mixed(m ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(leaves(s, percent))
                groups = coordinates(len(s))
                at = (s & np.uint64(groups - 1)).astype(np.int64)
                content = np.bincount(at, weights=m >> np.uint64(56), minlength=groups).astype(np.int64)
                vectors.append(packed(np.bincount(at, minlength=groups), content & 255))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, POINTS_AT_ONCE), pa.array(size, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), _lists(keys), pa.array(vectors, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "leaves", "point"],
            )


def points(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per document: set size, fingerprint of the set, leaf keys, count vector."""
    return docs.select("doc_id", "text").mapInArrow(tidied(lambda batches: point_batches(batches, width, percent)), _POINTS)


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, shingles`` of ``doc_id, text``, about ``SHINGLES_AT_ONCE`` shingles in a batch."""
    for batch in batches:
        ids, low, held, n = batch.column("doc_id").cast(pa.int64()), 0, [], 0
        for high, s in enumerate(shingle_sets(batch.column("text"), width), 1):
            held.append(s)
            n += len(s)
            if n >= SHINGLES_AT_ONCE or high == len(batch):
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), _lists(held)], ["doc_id", "shingles"])
                low, held, n = high, [], 0


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles`` of the wanted documents and a few others; texts are picked where they lie, not shuffled."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("h"), "text")
    picked = perhaps(rows, wanted.select(F.col("doc_id").alias("h"))).select(F.col("h").alias("doc_id"), "text")
    return picked.mapInArrow(tidied(lambda batches: set_batches(batches, width)), "doc_id bigint, shingles array<bigint>")


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and summed coordinate minima allow, with the sizes."""
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("point").alias(f"p{k}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = []
            for x, y, k in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), range(len(batch)), strict=True):
                x, y = unpacked(x), unpacked(y)
                groups = min(x.shape[1], y.shape[1])
                most = int(most_common(folded(x, groups)[None], folded(y, groups))[0])
                keep.append((100 + percent) * most >= percent * int(na[k] + nb[k]))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(tidied(run), "a bigint, b bigint, na bigint, nb bigint")


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, from pairs with sizes; only their documents' sets are made."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = write_table(_sets(docs, wanted, width), "sets")
    texts = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}"))
    overlap = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b", "na", "nb").join(texts("b"), "b").join(texts("a"), "a")
    found = joined.where((100 + percent) * overlap >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct()
    return write_table(found, "links")


def _relabel(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after the links found so far."""
    joined = connected_components(edges)
    new = label.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    return write_table(new.select("rep", F.coalesce("component", "rep").alias("comp")), "label")


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Shingle set size and component of every document under ``|a n b| / |a u b| >= percent / 100``.

    Returns ``doc_id, n_shingles, component_id, class_id``: the smallest document
    reachable by links, and the smallest with the same set. Documents without words
    (null, empty or blank texts) link with nothing. Rows that repeat a ``doc_id``
    are one document each in ``n_shingles`` and one node in the links; rows with a
    null ``doc_id`` link with nothing. Columns other than ``doc_id`` and ``text`` are not read.
    """
    made, some = points(docs, width, percent), "n_shingles > 0 and doc_id is not null"
    # leaves are most of a point: they are made once more for their shuffle, not written
    found = write_table(made.drop("leaves"), "points")
    full = found.where(some)
    key = ["f1", "f2", "n_shingles"]
    classes = write_table(
        full.groupBy(*key).agg(F.min(F.struct("doc_id", "point")).alias("r")).select(*key, F.col("r.doc_id").alias("rep"), F.col("r.point").alias("point")),
        "classes",
    )
    members = _members(made.where(some), classes)
    label = members.select("rep").distinct().select("rep", F.col("rep").alias("comp"))
    first = members.where("lo < rep").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    edges = _linked(write_table(_allowed(first, classes, percent), "allowed"), docs, width, percent)
    label = _relabel(label, edges)
    # in a leaf of two, the only pair has met
    crowded = members.where("size > 2")
    for nearest in (True, False):  # a document's likeliest partner first, then whatever is still apart
        rest = write_table(_inside(crowded, label, classes, percent, nearest), "rest")
        edges = write_table(edges.unionByName(_linked(rest.select("a", "b", "na", "nb").distinct(), docs, width, percent)), "links")
        label = _relabel(label, edges)
        crowded = crowded.join(rest.where("more").select("leaf").distinct(), "leaf", "left_semi")

    part = label.select(F.col("rep"), "comp")
    grouped = classes.select(*key, "rep").join(part, "rep", "left").select(*key, F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id"))
    out = full.select("doc_id", *key).join(grouped, key).select("doc_id", "n_shingles", "component_id", "class_id")
    bare = found.where(f"not ({some})")
    return out.unionByName(bare.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")))


def _members(full: DataFrame, classes: DataFrame) -> DataFrame:
    """``leaf, rep, lo, size`` of the leaves that two classes or more share; ``lo`` is the smallest member."""
    entries = full.select(F.col("doc_id").alias("rep"), F.explode("leaves").alias("leaf"))
    leaf = W.partitionBy("leaf")  # one shuffle of all leaves: most are of one document
    shared = entries.withColumns({"lo": F.min("rep").over(leaf), "hi": F.max("rep").over(leaf)}).where("lo < hi")
    found = write_table(shared.select("leaf", "rep", "lo"), "entries")
    # exact copies have left: one row per class and leaf
    found = found.join(classes.select("rep"), "rep", "left_semi")
    sizes = found.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    return write_table(found.join(sizes, "leaf").select("leaf", "rep", "lo", "size"), "members")


def _inside(members: DataFrame, label: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs in a leaf of different components, without its smallest document, that the boxes and points allow.

    A leaf is cut into blocks of about ``BLOCK`` documents, and two blocks meet in
    one group of bounded size, however many documents share the leaf. With ``nearest``
    a document of a block gives one pair, that with the greatest possible similarity,
    so the rows out of two blocks are as many as their documents, and ``more`` tells that it had
    others. Returns ``leaf, a, b, more`` with the sizes; a pair of several leaves comes from each.
    """
    at = members.join(label, "rep").select("leaf", "rep", "lo", "size", "comp")
    several = at.groupBy("leaf").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("leaf")
    inner = (
        at.join(several, "leaf", "left_semi").where("rep <> lo")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.hash("rep"), F.col("blocks")))
        .join(classes.select("rep", "n_shingles", "point"), "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "n_shingles", "point")
    )

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = key[1].as_py(), key[2].as_py()
        take = lambda name: group.column(name).to_numpy()
        own, rep, comp, size = take("own"), take("rep"), take("comp"), take("n_shingles")
        points = group.column("point").to_pylist()
        groups = min((len(p) - 1) // (p[0] + 1) for p in points)
        point = np.array([folded(unpacked(p), groups) for p in points])
        counts = point[:, 0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        if len(left) and len(right):
            box, least = counts[right].max(axis=0), size[right].min()
            fits = (100 + percent) * np.minimum(counts[left], box).sum(axis=1) >= percent * (size[left] + least)
            for k in left[fits]:
                others = right[(comp[right] != comp[k]) & ((rep[right] > rep[k]) | (i != j))]
                most = np.minimum(counts[others], counts[k]).sum(axis=1, dtype=np.int64)
                others = others[(100 + percent) * most >= percent * (size[others] + size[k])]
                if not len(others):
                    continue
                most = most_common(point[others], point[k])
                fine = (100 + percent) * most >= percent * (size[others] + size[k])
                others, most = others[fine], most[fine]
                more = np.full(len(others), nearest and len(others) > 1)
                if nearest and len(others):
                    others, more = others[[np.argmax(most / (size[others] + size[k] - most))]], more[:1]
                swap = rep[others] < rep[k]
                order = lambda values: (np.where(swap, values[others], values[k]), np.where(swap, values[k], values[others]))  # noqa: B023,E731
                (a, b), (na, nb) = order(rep), order(size)
                for column, values in zip(found, (a, b, na, nb, more), strict=True):
                    column.append(values)
        joined = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in found]
        return pa.table([pa.array([key[0].as_py()] * len(joined[0]), pa.int64()), *joined[:4], joined[4].cast(pa.bool_())], names=["leaf", "a", "b", "na", "nb", "more"])

    return inner.groupBy("leaf", "i", "j").applyInArrow(meet, "leaf bigint, a bigint, b bigint, na bigint, nb bigint, more boolean")


def unique(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The smallest document of every group, with all columns, whatever their names; documents without words and null ids stay."""
    drop = similar(docs, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    return rows.join(drop, F.col("_doc.doc_id") == F.col("_id"), "left_anti").select("_doc.*")
