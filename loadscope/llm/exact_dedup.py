"""Exact duplicates by 128-bit content hash, with a byte comparison inside the groups.

One aggregation per content hash counts the rows and picks the id that stays; no text
is shuffled for it. Of the hashes with several rows a second one takes the smallest
and largest normalised text. Texts of a group are equal byte for byte exactly when
these two are, so no group is gathered: every task combines its own rows before the
shuffle. Which rows have such a hash is read from a map of bits of fixed size; rows that
it names by chance are compared with themselves. Only ids, sizes and hashes are kept of the groups. Were two different texts to share a hash, the rows of that hash
would be grouped by the whole text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.session import write_table

#: Bits of the map that tells hashes of several rows: 4 MB.
BITS = 1 << 25

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def perhaps(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows with one of the hashes, and a few others: a map of ``BITS`` bits, whatever the table, says which."""
    # the functions count from 1
    place = lambda: F.pmod(F.xxhash64("h"), F.lit(BITS)) + 1
    at = hashes.select(place().alias("_p"))
    bits = at.groupBy(F.bitmap_bucket_number("_p").alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    placed = rows.withColumn("_k", F.bitmap_bucket_number(place())).withColumn("_bit", F.bitmap_bit_position(place()))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    # BITS / 8 bytes at most
    return placed.join(F.broadcast(bits), "_k").where(byte.bitwiseAND(F.expr("shiftleft(1L, cast(_bit % 8 as int))")) != 0).select(*rows.columns)


def duplicates(docs: DataFrame, keep: str = "max", content_hash: Callable[[Column], Column] = _md5) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``keep`` is the aggregate that picks the id that stays ("min" or "max"). Null
    and empty texts are one group. Rows that repeat a ``doc_id`` with the same text
    count in ``group_size`` and share one verdict; null ids are kept only if no row
    of the group has an id. An empty table gives no rows. Only ``doc_id`` and
    ``text`` are read, whatever the other columns are called.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", "norm", content_hash(F.col("norm")).alias("h"))
    stays = getattr(F, keep)
    counted = write_table(rows.groupBy("h").agg(stays("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "counted")
    bounds = (
        perhaps(rows, counted.where("group_size > 1").select("h")).groupBy("h")
        .agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("h", F.lit(True).alias("mixed"))
    )
    groups = write_table(counted.join(bounds, "h", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))), "groups")
    sha = F.sha2("norm", 256).alias("text_sha256")
    verdict = lambda: (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")
    plain = (
        rows.select("doc_id", "h", sha).join(groups.where("not mixed"), "h")
        .select("doc_id", "keep_id", "group_size", verdict(), "text_sha256")
    )
    mixed = groups.where("mixed").select("h")
    if mixed.isEmpty():
        return plain
    # different texts under one hash: the text itself is the key
    apart = rows.join(mixed, "h", "left_semi")
    exact = apart.groupBy("norm").agg(stays("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return plain.unionByName(
        apart.join(exact, "norm").select("doc_id", "keep_id", "group_size", verdict(), sha)
    )


def unique(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; the smallest id of each group, and one row of each id and text."""
    of = lambda id_, sha: F.concat_ws(":", F.coalesce(F.col(id_).cast("string"), F.lit("-")), sha).alias("_row")
    stays = duplicates(docs, keep="min").where("kept").select(of("doc_id", F.col("text_sha256"))).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    rows = rows.select("_doc", of("_doc.doc_id", F.sha2(normalised(F.col("_doc.text")), 256)))
    return rows.join(stays, "_row").dropDuplicates(["_row"]).select("_doc.*")
