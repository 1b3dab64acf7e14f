"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1 (linear between equally
spaced knots). The integral of the schedule is its weight, and the weights share the
words of the mix; a target stops at ``cap`` times the source's size and the excess goes
to the others by weight. Cumulative demand of a source is its target times the
integral of its schedule up to a time, so the inverse of the demand at a document's
place in its source is the time at which the document is read. Sorting by that time
by ranges gives the order of training.

Places are running sums of sizes in the order of a hash. They are taken in two
levels, per cell of the hash and within a cell, so that a source with a third of
all rows is cut into ``16 ** CELL_DIGITS`` parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.session import write_table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights 3, 1, 2: falling, steady and rising over training.
SCHEDULES = ((4.0, 2.0), (1.0, 1.0), (1.0, 3.0))
CELL_DIGITS = 3


def integral(knots: Sequence[float]) -> float:
    return sum((a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)) / (len(knots) - 1)


def targets(sized: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_no, source_size, weight, target`` from rows of ``source, size``.

    Sources are numbered by code point, null last, and take the schedules in turn.
    With the sources sorted by the demand at which they reach their cap, one pass
    finds how many are capped and the level of all others.
    """
    weights = F.array(*[F.lit(integral(k)) for k in schedules])
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(ordered) - 1)
        .withColumn("weight", F.element_at(weights, (F.col("source_no") % len(schedules) + 1).cast("int")))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
    )
    by_level = Window.partitionBy(F.lit(0)).orderBy("full_at", "source_no")
    everything = Window.partitionBy(F.lit(0))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = sources.withColumn("level", (total - before) / rest)
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))
    level = level.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return level.select("source", "source_no", "source_size", "weight", target.alias("target"))


def time_of(share: Column, schedule_no: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source has read the given share of its target."""
    found = None
    for n, knots in enumerate(schedules):
        steps, whole, at = len(knots) - 1, integral(knots), 0.0
        when = F.lit(1.0)
        parts = []
        for k in range(steps):
            area = (knots[k] + knots[k + 1]) / 2 / steps / whole
            parts.append((k, at, at + area))
            at += area
        for k, low, high in reversed(parts):
            need = (share - F.lit(low)) * F.lit(whole * steps)
            slope = (knots[k + 1] - knots[k]) / 2
            root = F.sqrt(F.greatest(F.lit(knots[k] ** 2) + F.lit(4 * slope) * need, F.lit(0.0)))
            inside = F.lit(2.0) * need / (F.lit(knots[k]) + root)
            when = F.when(share <= F.lit(low), F.lit(k / steps)).when(
                share <= F.lit(high), F.least(F.lit(1.0), inside) / F.lit(float(steps)) + F.lit(k / steps)
            ).otherwise(when)
        found = when if found is None else F.when(schedule_no == n, when).otherwise(found)
    return found


def sizes(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return docs.select("doc_id", "source", *keep, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0, keep: Sequence[str] = ()) -> DataFrame:
    """How often every document is read, and when: ``doc_id, source, size, source_size, target, taken, copies, place, filled, source_no``.

    Every document is read ``floor(target / source_size)`` times; the words that are
    still missing come from the first documents in hash order up to the first that does
    not fit, and the gap is filled from the others until none of them fits, see
    :func:`_filled`; ``filled`` is then the place of the last copy. A source without
    words has target 0 and reads nothing. A null source is a source; null texts have size 0
    and very long ones are counted whole; rows that repeat a ``doc_id`` are documents of
    their own. An empty table gives no rows. Columns named in ``keep`` are carried along,
    and must not be called like a column of the result; others are not read.
    """
    rows = write_table(
        sizes(docs, keep).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("cell", F.substring("h", 1, CELL_DIGITS)), "sizes",
    )
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("start"))
    cells = write_table(
        cells.join(targets(rows.select("source", "size"), schedules, share, cap).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source_no", "source", "cell", "start", "source_size", "target", "whole", "missing"),
        "cells",
    )
    c = cells.withColumnRenamed("source", "s").withColumnRenamed("cell", "c")
    inside = Window.partitionBy("source_no", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .withColumn("end", F.col("start") + F.sum("size").over(inside))
        .withColumn("more", (F.col("end") <= F.col("missing")).cast("int"))
        .drop("s", "c", "h", "start")
    )
    placed = write_table(placed, "placed")
    had = placed.where("more = 1").groupBy("source_no").agg(F.sum("size").alias("had"))
    gaps = cells.groupBy("source_no").agg(F.first("missing").alias("missing")).join(had, "source_no", "left")
    gaps = gaps.select("source_no", (F.col("missing") - F.coalesce("had", F.lit(0))).alias("gap"))
    picks = _filled(placed, write_table(gaps, "gaps")).withColumnRenamed("source_no", "no").withColumnRenamed("end", "stop")
    missed = F.col("missing") - F.col("room")
    out = placed.join(picks, (F.col("source_no") == F.col("no")) & (F.col("end") == F.col("stop")) & (F.col("size") > 0), "left")
    chosen = (F.col("more") == 1) | F.col("room").isNotNull()
    out = out.withColumn("copies", F.col("whole").cast("int") + chosen.cast("int"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        "copies", (F.col("end") - F.col("size")).alias("place"), missed.alias("filled"), "source_no", *keep,
    )


def _filled(placed: DataFrame, gaps: DataFrame) -> DataFrame:
    """``source_no, end, room`` of the documents that fill the gaps, with the gap that each found.

    A round takes the largest document that fits, and then all others that fit
    up to the first that does not, in hash order; documents larger than the gap are set
    aside. Two rounds at least halve a gap, so their number is that of its digits.
    """
    rest = placed.where("more = 0 and size > 0").select("source_no", "cell", "end", "size")
    picks = None
    while True:
        rest = write_table(rest.join(gaps, "source_no").where("size <= gap").select("source_no", "cell", "end", "size"), "rest")
        largest = rest.groupBy("source_no").agg(F.max(F.struct("size", F.negative("end").alias("e"))).alias("f"))
        largest = write_table(
            largest.join(gaps, "source_no").select("source_no", (-F.col("f.e")).alias("end"), F.col("gap").alias("room"), F.col("f.size").alias("size")), "largest"
        )
        picks = largest if picks is None else picks.unionByName(largest)
        if largest.isEmpty():
            return picks.select("source_no", "end", "room")
        left = largest.select("source_no", F.col("end").alias("top"), (F.col("room") - F.col("size")).alias("gap"))
        fits = rest.join(left, "source_no").where("end <> top and size <= gap").drop("top")
        cells = fits.groupBy("source_no", "cell").agg(F.sum("size").alias("cell_size"))
        before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).drop("cell_size")
        inside = Window.partitionBy("source_no", "cell").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
        prefix = (
            fits.join(cells, ["source_no", "cell"]).where("start < gap").withColumn("sum", F.col("start") + F.sum("size").over(inside)).where("sum <= gap")
            .select("source_no", "end", (F.col("gap") - F.col("sum") + F.col("size")).alias("room"), "size")
        )
        prefix = write_table(prefix, "prefix")
        picks = picks.unionByName(prefix)
        sums = prefix.groupBy("source_no").agg(F.sum("size").alias("had"))
        gaps = write_table(left.join(sums, "source_no", "left").select("source_no", (F.col("gap") - F.coalesce("had", F.lit(0))).alias("gap")), "gaps")
        taken = largest.select("source_no", "end").unionByName(prefix.select("source_no", "end"))
        rest = rest.join(taken, ["source_no", "end"], "left_anti")


def position(copy: Column, schedules=SCHEDULES) -> Column:
    """Training time of the given copy (from 0) of a document of :func:`mix`."""
    place = F.when(F.col("filled").isNotNull() & (copy == F.col("copies") - 1), F.col("filled")).otherwise(F.col("place"))
    middle = place + F.col("size") / F.lit(2.0) + copy * F.col("source_size")
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle / F.col("target"))).otherwise(F.lit(0.0))
    return time_of(share, F.col("source_no") % len(schedules), schedules)


def reads(plan: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row for every copy of a document that a plan of :func:`mix` reads, with ``copy`` (from 0) and its training ``time``."""
    some = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return some.withColumn("time", position(F.col("copy"), schedules))


def dealt(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """What the training reads of every document: ``doc_id, source, size, source_size, target, taken, first_time, last_time``.

    The reads of :func:`mix` are sorted by training time by ranges and written, without
    texts; ``taken`` is the words of a document's reads, and the times are those of its first
    and last one, null if it has none. Odd rows are treated as in :func:`mix`.
    """
    plan = write_table(mix(docs, schedules, share, cap), "plan")
    order = write_table(reads(plan.where("size > 0"), schedules).select("time", "source_no", "place", "copy", "size").orderBy("time", "source_no", "place", "copy"), "reads")
    # a document with words is known by its place in its source
    sums = order.groupBy(F.col("source_no").alias("no"), F.col("place").alias("at")).agg(F.sum("size").alias("words"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    found = plan.join(sums, (F.col("source_no") == F.col("no")) & (F.col("place") == F.col("at")) & (F.col("size") > 0), "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"), "first_time", "last_time")


def _row(docs: DataFrame) -> Column:
    """Key of a row: equal only for rows with the same id, source and text."""
    parts = [F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit(""))), F.coalesce(docs["source"], F.lit("\x00"))]
    return F.concat_ws(":", *parts)


def curriculum(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: every document as often as it is read, sorted by training time, with the columns of ``docs``.

    Documents without words belong to no target and are read once. Rows equal in
    id, source and text are read as often as all of them together.
    """
    plan = mix(docs.withColumn("_row", _row(docs)), schedules, share, cap, keep=("_row",))
    plan = plan.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1)))
    order = reads(plan, schedules).select(F.col("_row").alias("_read"), F.col("time").alias("_time"))
    texts = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), _row(docs).alias("_row")).dropDuplicates(["_row"])
    return texts.join(order, F.col("_row") == F.col("_read")).orderBy("_time", "_row").select("_doc.*")
