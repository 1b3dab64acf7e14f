"""Global order without a single-partition window.

Three ways to cut an ordered table into bounded pieces are used here:

* **dense ids** — a cell of ``CELL`` consecutive unique ids holds at most
  ``CELL`` rows, whatever the data looks like;
* **hash order** — the leading bits of a row hash are uniform, so every cell
  gets the same share of the rows;
* **any other order** — runs between boundaries of a sort key that ends in a unique
  id. Because the id is part of the key, a hot time stamp or a hot group is cut like
  everything else. The boundaries come from a sample by hash of the id, so every
  scan sees the same cuts, also after an executor is lost: nothing is written, and
  the rows are shuffled once.

Each piece is ordered on its own; only one row per piece goes through an
un-partitioned window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadscope.functions.randomness import HASH_BITS, hash52

CELL = 1 << 16
HASH_CELL_BITS = 16
#: Rows tried first for every row wanted of a shuffle that drops rows.
TRIED = 4
#: Sampled rows for every run; a run's size differs from the mean by about an eighth.
SAMPLED = 64


def _before(pieces: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """Exclusive running sum over a table with one row per piece."""
    upto = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return pieces.withColumn(out, F.coalesce(F.sum(amount).over(upto), F.lit(0)).cast("bigint"))


def prefix_sum(
    df: DataFrame, row_id: str, value: str, out: str, *, inclusive: bool = True, cell: int = CELL
) -> DataFrame:
    """Running sum of an integer column in the order of a unique integer id.

    The rows are shuffled once: the window and the join both use the cell, and the
    cell totals are map-side aggregated. The totals are summed in two levels, so only
    one row per ``cell * cell`` ids is ordered globally, also where ids are sparse and
    a cell holds few rows.
    """
    rows = df.withColumn("_cell", F.floor(F.col(row_id) / F.lit(cell)))
    totals = rows.groupBy("_cell").agg(F.sum(value).cast("bigint").alias("_total"))
    totals = totals.withColumn("_block", F.floor(F.col("_cell") / F.lit(cell)))
    blocks = totals.groupBy("_block").agg(F.sum("_total").alias("_amount"))
    bases = _before(blocks, "_block", "_amount", "_base").select("_block", "_base")
    in_block = W.partitionBy("_block").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_near", F.coalesce(F.sum("_total").over(in_block), F.lit(0)))
        .join(bases, "_block")
        .select("_cell", (F.col("_near") + F.col("_base")).alias("_offset"))
    )
    inside = W.partitionBy("_cell").orderBy(row_id)
    running = F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0))
    if not inclusive:
        running = running - F.col(value)
    return (
        rows.withColumn("_running", running.cast("bigint"))
        .join(offsets, "_cell")
        .withColumn(out, F.col("_running") + F.col("_offset"))
        .drop("_cell", "_running", "_offset")
    )


def hash_rank(
    df: DataFrame, row_id: Column, seed, out: str, *, upto: Column | int | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None, bits: int = HASH_CELL_BITS,
) -> DataFrame:
    """0-based position of each row in a seeded shuffle; optionally only the first ``upto``.

    ``keep`` derives columns and drops rows before they are ranked. The cells are
    counted first, at most ``2**bits`` rows, which bounds the broadcast. With
    ``upto`` the second scan stops at the last cell needed: the cutoff is a plain
    filter on the id ahead of ``keep``, so an expensive ``keep`` (token counting)
    runs for a few times ``upto`` rows: first for the cells of the first ``TRIED * upto``
    rows, and for the others only where too few of those are kept. A top-n by
    sorting would instead send ``n`` rows of every task to a single one.
    """
    early = keep is not None and upto is not None
    keep = keep or (lambda rows: rows)
    keyed = df.withColumn("_key", hash52(row_id, seed)).withColumn("_tie", row_id)
    keyed = keyed.withColumn("_cell", F.shiftright("_key", HASH_BITS - bits))
    limit = upto if upto is None or isinstance(upto, Column) else F.lit(upto)
    counts = _early_counts(keyed, keep, limit) if early else _per_cell(keep(keyed))
    offsets = _before(counts, "_cell", "_rows", "_offset").select("_cell", "_offset")
    if upto is not None:
        offsets = offsets.where(F.col("_offset") < limit)
        keyed = keyed.where(F.col("_cell") <= offsets.agg(F.max("_cell").alias("c")).scalar())
    inside = W.partitionBy("_cell").orderBy("_key", "_tie")
    rows = keep(keyed).join(F.broadcast(offsets), "_cell")
    rows = rows.withColumn(out, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("bigint"))
    if upto is not None:
        rows = rows.where(F.col(out) < limit)
    return rows.drop("_cell", "_key", "_tie", "_offset")


def _per_cell(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))


def _early_counts(keyed: DataFrame, keep: Callable[[DataFrame], DataFrame], limit: Column) -> DataFrame:
    """Kept rows of the first cells, and those of all others only if the first hold fewer than ``limit``.

    The others are joined with one row, or none if they are not needed: adaptive
    execution then leaves out their scan.
    """
    tried = _before(_per_cell(keyed), "_cell", "_rows", "_offset").where(F.col("_offset") < limit * TRIED)
    last = F.coalesce(tried.agg(F.max("_cell").alias("c")).scalar(), F.lit(-1))
    near = _per_cell(keep(keyed.where(F.col("_cell") <= last)))
    short = near.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_found")).where(F.col("_found") < limit)
    # 0 on both sides, from columns: an equality of literals would be folded into a join without a key
    others = keyed.where(F.col("_cell") > last).withColumn("_open", F.shiftright("_cell", 62))
    needed = others.join(F.broadcast(short.select(F.shiftright("_found", 62).alias("_open"))), "_open", "left_semi").drop("_open")
    return near.unionByName(_per_cell(keep(needed))).groupBy("_cell").agg(F.sum("_rows").alias("_rows"))


def _last_before(rows: DataFrame, piece: Column, n: int, taken: Column) -> DataFrame:
    """The piece that holds the ``n``-th row, and the rows before it; ``taken`` rows come before all."""
    counts = rows.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_rows"))
    placed = _before(counts, "_piece", "_rows", "_offset").withColumn("_offset", F.col("_offset") + taken)
    return placed.where(F.col("_offset") < n).agg(F.max_by(F.struct("_piece", "_offset"), "_piece").alias("_at"))


def hash_first(df: DataFrame, row_id: Column, seed, n: int, bits: int = HASH_CELL_BITS) -> DataFrame:
    """The first ``n`` rows of a seeded shuffle, all of them when there are fewer.

    A plain filter: the key of the ``n``-th row is found from counts of hash cells, then of
    the cells inside that one, and the rows of the last cell, one in ``4**bits``, are ordered.
    No other row is shuffled, and nothing is written.
    """
    keys = df.select(hash52(row_id, seed).alias("_key"), row_id.alias("_tie"))
    outer, inner = (F.shiftright("_key", HASH_BITS - k * bits) for k in (1, 2))
    first = _last_before(keys, outer, n, F.lit(0)).scalar()
    inside = keys.withColumn("_at", first).where(outer == F.col("_at._piece"))
    second = _last_before(inside, inner, n, first["_offset"]).scalar()
    last = keys.withColumn("_at", second).where(inner == F.col("_at._piece"))
    bound = _last_before(last, F.struct("_key", "_tie"), n, second["_offset"]).scalar()["_piece"]
    return df.where(F.struct(hash52(row_id, seed).alias("_key"), row_id.alias("_tie")) <= bound)


def first_by_id(df: DataFrame, row_id: str, n: int, out: str, *, cell: int = CELL) -> DataFrame:
    """The first ``n`` rows in the order of a unique integer id with their 0-based position.

    ``n`` may grow with the table. Ids are counted by block and, in the block of the
    ``n``-th row only, by cell; rows beyond that cell are neither sorted nor shuffled.
    """
    at = F.floor(F.col(row_id) / F.lit(cell))
    block = F.floor(at / F.lit(cell))
    first = _last_before(df, block, n, F.lit(0)).scalar()
    inside = df.withColumn("_first", first).where(block == F.col("_first._piece")).select(row_id, "_first")
    taken = F.lit(0) if n < 1 else first["_offset"]
    last = _last_before(inside, at, n, taken).scalar()["_piece"]
    head = df.where(at <= last).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = prefix_sum(head, row_id, "_one", out, inclusive=False, cell=cell).drop("_one")
    return numbered.where(F.col(out) < n)


def _key(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])


def sorted_runs(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``_run``: even ranges of ``order`` (which must end in a unique column), increasing with it.

    About ``partitions`` runs, by default as many as shuffle partitions. The boundaries
    are every 64th row of a sample of at most about 64 rows a run.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.lit(float(SAMPLED * partitions) * 2.0**HASH_BITS) / F.nullif(rows, F.lit(0))
    spread = F.shiftrightunsigned(F.xxhash64(F.lit("run"), order[-1]), 64 - HASH_BITS)
    sample = df.where(spread < share).select(_key(order).alias("_at")).distinct()
    numbered = sample.withColumn("_no", F.row_number().over(W.orderBy("_at")))
    chosen = numbered.where(F.col("_no") % SAMPLED == 0)
    bounds = chosen.agg(F.array_sort(F.collect_list("_at")).alias("_bounds")).scalar()
    # a binary search: the number of boundaries up to the row
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((2 * partitions).bit_length()))])

    def further(found: Column, step: Column) -> Column:
        reached = (found + step <= F.size("_bounds")) & (F.get("_bounds", found + step - 1) <= F.col("_at"))
        return F.when(reached, found + step).otherwise(found)

    placed = df.withColumns({"_bounds": bounds, "_at": _key(order)})
    return placed.withColumn("_run", F.aggregate(steps, F.lit(0), further)).drop("_bounds", "_at")


def run_row_number(runs: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based global row number of a table from :func:`sorted_runs`."""
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _before(sizes, "_run", "_rows", "_offset").select("_run", "_offset")
    local = F.row_number().over(W.partitionBy("_run").orderBy(*order))
    return (
        runs.withColumn("_local", local)
        .join(F.broadcast(offsets), "_run")  # one row per run
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset")
    )


def run_row_number_by(runs: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based row number inside each key, for runs sorted by ``keys`` first.

    A key that spans several runs is numbered run by run; what precedes it comes
    from a table with one row per run.
    """
    key = _key(keys)
    per_key = runs.groupBy("_run", *keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", key)
    edges = per_key.groupBy("_run").agg(
        F.min("_key").alias("_head"), F.max("_key").alias("_tail"), F.max_by("_n", "_key").alias("_tail_n")
    )
    same_tail = W.partitionBy("_tail").orderBy("_run").rowsBetween(W.unboundedPreceding, 0)
    edges = edges.withColumn("_upto", F.sum("_tail_n").over(same_tail))
    previous = F.lag(F.struct("_tail", "_upto")).over(W.orderBy("_run"))
    edges = edges.withColumn("_prev", previous).select(
        "_run",
        "_head",
        F.when(F.col("_prev._tail").eqNullSafe(F.col("_head")), F.col("_prev._upto"))
        .otherwise(0)
        .alias("_carry"),
    )
    # partitioned by the run alone, so that a row number and a lag share the shuffle's layout
    by = W.partitionBy("_run").orderBy(*keys, *order)
    start = F.min("_place").over(W.partitionBy("_run", *keys))
    return (
        runs.withColumn("_place", F.row_number().over(by))
        .withColumn("_local", F.col("_place") - start + 1)
        .join(F.broadcast(edges), "_run")  # one row per run
        .withColumn(
            out,
            F.col("_local")
            + F.when(key.eqNullSafe(F.col("_head")), F.col("_carry")).otherwise(0),
        )
        .drop("_place", "_local", "_head", "_carry")
    )


def run_lag(runs: DataFrame, order: list[str], values: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Previous row's values (``{out: column}``) in run order, NULL at the start of a key.

    The first row of a run takes the last row of the run before it, from a table
    with one row per run.
    """
    keys = keys or []
    full = [*keys, *order]
    kept = {**{f"_key{i}": k for i, k in enumerate(keys)}, **{f"_value{i}": c for i, c in enumerate(values.values())}}
    row = F.struct(F.lit(True).alias("_seen"), *[F.col(c).alias(n) for n, c in kept.items()])
    last = runs.groupBy("_run").agg(F.max_by(row, _key(full)).alias("_last"))
    last = last.select("_run", F.lag("_last").over(W.orderBy("_run")).alias("_carried"))
    before = W.partitionBy("_run").orderBy(*full)
    near = {n: F.lag(c).over(before) for n, c in kept.items()}
    joined = runs.withColumns({**near, "_seen": F.lag(F.lit(True)).over(before)}).join(F.broadcast(last), "_run")

    def previous(name: str) -> Column:
        return F.when(F.col("_seen"), F.col(name)).otherwise(F.col(f"_carried.{name}"))

    same = F.coalesce("_seen", "_carried._seen")
    for i, k in enumerate(keys):
        same = same & previous(f"_key{i}").eqNullSafe(F.col(k))
    outs = {out: F.when(same, previous(f"_value{i}")) for i, out in enumerate(values)}
    return joined.withColumns(outs).drop("_carried", "_seen", *kept)


def row_number(
    df: DataFrame, order: list[str], out: str, *, keys: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """1-based row number over the table, or inside each key; ``order`` ends in a unique id."""
    runs = sorted_runs(df, [*(keys or []), *order], partitions)
    numbered = run_row_number_by(runs, keys, order, out) if keys else run_row_number(runs, order, out)
    return numbered.drop("_run")


def lag(
    df: DataFrame, order: list[str], values: dict[str, str], *, keys: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Values of the previous row over the table, or inside each key."""
    runs = sorted_runs(df, [*(keys or []), *order], partitions)
    return run_lag(runs, order, values, keys).drop("_run")
