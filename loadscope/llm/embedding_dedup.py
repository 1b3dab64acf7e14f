"""Near-duplicate vectors by random-hyperplane signs in several tables.

Equal vectors are one class first. The signs of a class against the hyperplanes of a
table name its cell there; bits and tables follow from the number of classes, so
that a cell holds about ``CELL`` classes and a pair at the threshold is missed by
all tables with probability at most ``MISS``. Cells are compared block by block with
exact cosines in double precision, so the work of one task is bounded by two blocks
however many vectors share a cell. A pair that meets in several tables is reported
by the first of them alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.components import connected_components
from loadscope.session import write_table

CELL = 256
BLOCK = 512
MISS = 0.002


def layout(classes: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(1, math.ceil(math.log2(max(2.0, classes / CELL))))
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def _packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec``: the components of usable vectors as little-endian doubles; null for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None
                if v.is_valid and not v.values.null_count:
                    x = v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                    x = x if len(x) and np.isfinite(x).all() and x.any() else None
                out.append(None if x is None else x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], ["id", "vec"])

    return vectors.select(id_col, vec_col).mapInArrow(run, "id bigint, vec binary")


def _unit(blobs) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``rep, vec, copies, cells``: the class's cell in every table, numbered over all tables; vectors of each length apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (np.int64(1) << np.arange(bits, dtype=np.int64))[None, None, :]
        for batch in batches:
            blobs = batch.column("vec").to_pylist()
            cells = np.zeros((len(blobs), tables), np.int64)
            lengths = np.array([len(b) // 8 for b in blobs], np.int64)
            for n in np.unique(lengths).tolist():
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n, tables * bits))
                rows = np.flatnonzero(lengths == n)
                signs = (_unit([blobs[k] for k in rows]) @ planes[n] >= 0).reshape(len(rows), tables, bits)
                cells[rows] = (signs * weights).sum(axis=2)
            flat = pa.array(cells.ravel(), pa.int64())
            at = pa.array(np.arange(len(blobs) + 1) * tables, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, flat)], [*batch.schema.names, "cells"])

    return classes.select("rep", "vec", "copies").mapInArrow(run, "rep bigint, vec binary, copies bigint, cells array<bigint>")


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric table of links, the first member that each member reaches."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(placed: DataFrame, threshold: float) -> DataFrame:
    """``rep, n, root``: for each class and tile in which it has links, the vectors it links with there and one class it reaches.

    A pair counts in the first table that brings it together. A tile gives a row per
    member at most, however many of its pairs link.
    """
    entries = placed.select("rep", "vec", "copies", "cells", F.octet_length("vec").alias("n"), F.posexplode("cells").alias("t", "cell"))
    key = ["n", "t", "cell"]
    crowded = entries.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1")
    tiles = (
        entries.join(crowded, key)
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.hash("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "vec", "copies", "cells")
    )

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        table, i, j = key[1].as_py(), key[3].as_py(), key[4].as_py()
        own, rep = group.column("own").to_numpy(), group.column("rep").to_numpy()
        unit = _unit(group.column("vec").to_pylist())
        cells = group.column("cells").chunk(0).flatten().to_numpy().reshape(len(rep), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        copies = group.column("copies").to_numpy()
        linked = unit[left] @ unit[right].T >= threshold
        linked &= rep[left][:, None] != rep[right][None, :]
        x, y = np.nonzero(linked)
        met = (cells[left[x], :table] == cells[right[y], :table]).any(axis=1)
        linked[x[met], y[met]] = False
        n = np.zeros(len(rep), dtype=np.int64)
        n[left] = linked @ copies[right]
        if i != j:
            n[right] = copies[left] @ linked
        whole = np.zeros((len(rep), len(rep)), dtype=bool)
        whole[np.ix_(left, right)] = linked
        whole |= whole.T
        root = _roots(whole)
        found = np.flatnonzero(n)
        return pa.table({"rep": pa.array(rep[found], pa.int64()), "n": pa.array(n[found], pa.int64()), "root": pa.array(rep[root[found]], pa.int64())})

    return tiles.groupBy(*key, "i", "j").applyInArrow(meet, "rep bigint, n bigint, root bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, all zero or hold null or non-finite components, and
    rows without an id, link with nothing. Vectors of different lengths do not link.
    Rows that repeat an id with the same vector are one vector; an id with several
    vectors has the links of all of them. An empty table gives no rows. Columns other
    than the two named are not read.
    """
    rows = write_table(_packed(vectors, id_col, vec_col), "vectors")
    good = rows.where("id is not null and vec is not null")
    classes = write_table(good.groupBy("vec").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies")), "classes")
    bits, tables = layout(classes.count(), threshold)
    placed = write_table(_cells(classes, bits, tables, seed), "cells")
    links = write_table(_links(placed, threshold), "links")
    beside = links.groupBy(F.col("rep").alias("a")).agg(F.sum("n").alias("beside"))
    joined = connected_components(links, "rep", "root")
    info = (
        classes.join(beside, F.col("rep") == F.col("a"), "left").drop("a")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("vec", (F.coalesce("beside", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = good.join(info, "vec").select("id", "n_links", "component_id")
    alone = rows.where("id is null or vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
