"""How the sources of a language differ in their words, from one pass over the texts.

The texts are indexed in blocks: a task gathers, for every term of a language, its
sources with their occurrences and documents until the block is full, and then
lets it go as one run, sorted by term, and begins the next. Runs are dealt by the hash
of language and term; the sort of that exchange merges the runs of a shard, and one
pass over the merged run sums neighbours and keeps the terms of enough documents.
Terms of few documents, most of them, end there.

Shares are whole numbers, ``1 + floor(scale * (count + smooth) / (N + smooth * V))``, so
all sums are exact. The distance of two sources adds up ``V`` terms, of which most
are in neither source or in one. It is therefore

* ``V`` times the distance of their shares of an absent term,
* corrected for the terms of each source as if the other lacked them all: this
  depends on how often a share occurs only, so a source needs its distinct shares,
* corrected for the terms that both have: streamed term by term into sums per pair
  of sources, which leave a task once they are many, and at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadscope.llm.words import distinct, ranges, slices, spans
from loadscope.session import write_table

#: Postings of a block: a term of one source.
BLOCK = 1_000_000
#: Sums of pairs that a task holds at once, and pairs of terms that it works out at once.
SUMS, PAIRS = 1_000_000, 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROWS = 1 << 15

_RUN = "lang string, term string, sources array<string>, n array<bigint>, docs bigint"
_KEPT = "lang string, term string, source string, n bigint"
RESULT = ["lang", "source", "part", "item", "value", "rank"]


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


class Block:
    """Postings of the terms of some texts: occurrences and documents of every term and group."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[np.ndarray] = []  # columns: term, group, occurrences, documents
        self.size = 0

    def add(self, data: np.ndarray, bounds: np.ndarray, groups: list[tuple[str, str]]) -> None:
        starts, ends, before = spans(_LETTER[data], bounds)
        if not len(starts):
            return
        small = _LOWER[data]
        one, kind = distinct(small, starts, ends)
        raw, number = small.tobytes(), self.terms
        term = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], dtype=np.int64)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], dtype=np.int64)
        n_docs = len(groups)
        key, often = np.unique(kind * n_docs + np.repeat(np.arange(n_docs), np.diff(before)), return_counts=True)
        kind, doc = key // n_docs, key % n_docs
        postings = _summed(term[kind], group[doc], often, np.ones(len(often), dtype=np.int64))
        self.parts.append(postings)
        self.size += postings.shape[1]

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block's terms by language and term, each with its sources."""
        if not self.parts:
            return
        term, group, n, docs = _summed(*np.concatenate(self.parts, axis=1))
        terms = pa.array(list(self.terms), pa.binary())
        rank = np.empty(len(terms), dtype=np.int64)
        rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        terms = terms.cast(pa.string())
        langs = pa.array([g[0] for g in self.groups], pa.string()).dictionary_encode()
        sources = pa.array([g[1] for g in self.groups], pa.string())
        lang = langs.indices.to_numpy()[group]
        order = np.lexsort((group, rank[term], lang))
        term, group, n, docs, lang = (x[order] for x in (term, group, n, docs, lang))
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])))
        sizes = np.diff(np.append(first, len(term)))
        docs = np.add.reduceat(docs, first)
        for at in range(0, len(first), _ROWS):
            rows = first[at : at + _ROWS]
            own = slice(rows[0], rows[-1] + sizes[at + len(rows) - 1])
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(lang[rows])), terms.take(pa.array(term[rows])),
                    _lists(sources.take(pa.array(group[own])), sizes[at : at + _ROWS]), _lists(pa.array(n[own]), sizes[at : at + _ROWS]), pa.array(docs[at : at + _ROWS]),
                ],
                ["lang", "term", "sources", "n", "docs"],
            )


def _summed(term: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One posting for every term and group."""
    key = term << 31 | group
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key = key[first]
    return np.stack([key >> 31, key & ((1 << 31) - 1), np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)])


def _runs(docs: DataFrame, block: int) -> DataFrame:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block()
        for batch in batches:
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            for row, data, bounds in slices(batch.column("text")):
                held.add(data, bounds, groups[row : row + len(bounds) - 1])
                if held.size >= block:
                    yield from held.run()
                    held = Block()
        yield from held.run()

    return docs.mapInArrow(index, _RUN)


def _merged(runs: DataFrame, least_docs: int) -> DataFrame:
    """Occurrences by source of the terms that at least ``least_docs`` documents of a language hold."""

    def summed(rows: pa.Table, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Group, source and occurrences, each group's sources once."""
        lists = rows.column("sources").combine_chunks()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        names = lists.flatten().dictionary_encode()
        many = max(1, len(names.dictionary))
        key = np.repeat(group, size) * many + names.indices.to_numpy()
        n = rows.column("n").combine_chunks().flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[first] // many, names.dictionary.take(pa.array(key[first] % many)), np.add.reduceat(n[order], first)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None  # the last term so far, as one row

        def closed(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            """The kept terms of ``rows``, whose terms begin at ``first``."""
            docs = np.add.reduceat(rows.column("docs").to_numpy(), first)
            group = np.cumsum(np.isin(np.arange(len(rows)), first)) - 1
            kept = docs >= least_docs
            rows, group = rows.filter(pa.array(kept[group])), group[kept[group]]
            if not len(rows):
                return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64())], ["lang", "term", "source", "n"])
            at, source, n = summed(rows, group, len(first))
            row = pa.array(np.searchsorted(group, at))
            return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(row) for c in ("lang", "term")] + [source, pa.array(n)], ["lang", "term", "source", "n"])

        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            if open_ is not None:
                rows = pa.concat_tables([open_, rows])
            rows = rows.combine_chunks()
            new = np.ones(len(rows), dtype=bool)
            for c in ("lang", "term"):
                values = rows.column(c).combine_chunks()
                change = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False).astype(bool)
                new[1:] = change if c == "lang" else new[1:] | change
            first = np.flatnonzero(new)
            if len(first) > 1:
                yield closed(rows.slice(0, first[-1]), first[:-1])
            last = rows.slice(first[-1])
            _, source, n = summed(last, np.zeros(len(last), dtype=np.int64), 1)
            open_ = pa.table(
                [last.column("lang")[:1], last.column("term")[:1], _lists(source, np.array([len(source)])), _lists(pa.array(n), np.array([len(n)])), pa.array([pc.sum(last.column("docs")).as_py()])],
                names=rows.column_names,
            )
        if open_ is not None:
            yield closed(open_, np.zeros(1, dtype=np.int64))

    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, _KEPT)


def _share(count: str, whole: str, smooth: int, scale: int) -> Column:
    """``1 + floor(scale * (count + smooth) / whole)`` by long division, three digits at a time; null without a whole."""
    if scale != 10**9:
        raise ValueError("shares are parts of 10^9")
    left, digits = f"({count} + {smooth})", []
    for _ in range(3):
        digits.append(f"(({left} * 1000) div {whole})")
        left = f"(({left} * 1000) % {whole})"
    return F.expr(f"case when {whole} > 0 then 1 + {digits[0]} * 1000000 + {digits[1]} * 1000 + {digits[2]} end")


def _one_sided(shares: DataFrame, others: DataFrame) -> DataFrame:
    """``lang, source, item, own``: correction for the terms of ``source`` as if ``item`` lacked them."""
    schema = "lang string, source string, item string, absent bigint, other_absent bigint, own bigint"

    def distances(key: tuple[pa.Scalar, ...], shares: pa.Table, others: pa.Table) -> pa.Table:
        p, k = (shares.column(c).to_numpy() for c in ("p", "terms"))
        order = np.argsort(p)
        p, k = p[order], k[order]
        terms, total = np.concatenate([[0], np.cumsum(k)]), np.concatenate([[0], np.cumsum(p * k)])
        absent, other = (others.column(c).to_numpy() for c in ("absent", "other_absent"))
        at = np.searchsorted(p, other)
        below = other * terms[at] - total[at]
        above = (total[-1] - total[at]) - other * (terms[-1] - terms[at])
        own = below + above - terms[-1] * np.abs(absent - other)
        return others.append_column("own", pa.array(own.astype(np.int64)))

    return others.groupBy("lang", "source").cogroup(shares.groupBy("lang", "source")).applyInArrow(lambda key, o, s: distances(key, s, o), schema)


def _shared(postings: DataFrame) -> DataFrame:
    """``lang, one, two, both``: correction for the terms that two sources have, ``one`` before ``two``."""
    schema = "lang string, one string, two string, both bigint"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}

        def out() -> pa.RecordBatch:
            columns = [*zip(*sums, strict=True)] if sums else [(), (), ()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(sums.values()), pa.int64())], ["lang", "one", "two", "both"])

        for batch in batches:
            lists = batch.column("sources")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = lists.flatten()
            names = entries.field("source").dictionary_encode()
            p, z = (entries.field(c).to_numpy() for c in ("p", "absent"))
            langs = batch.column("lang").dictionary_encode()
            many = len(names.dictionary)
            group = np.repeat(langs.indices.to_numpy().astype(np.int64), size) * many + names.indices.to_numpy()
            start = np.repeat(np.cumsum(size) - size, size)
            size = np.repeat(size, size)  # partners of every entry, itself included
            stops = np.cumsum(size)
            at = 0
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS, side="right")))
                i = np.repeat(np.arange(at, to), size[at:to])
                j = ranges(start[at:to], size[at:to])
                held = group[i] < group[j]
                i, j = i[held], j[held]
                extra = np.abs(p[i] - p[j]) + np.abs(z[i] - z[j]) - np.abs(p[i] - z[j]) - np.abs(p[j] - z[i])
                key, of = np.unique(group[i] * (many * len(langs.dictionary)) + group[j], return_inverse=True)
                total = np.zeros(len(key), dtype=np.int64)
                np.add.at(total, of, extra)
                for one, value in zip(key.tolist(), total.tolist(), strict=True):
                    a, b = divmod(one, many * len(langs.dictionary))
                    pair = sorted((names.dictionary[a % many].as_py(), names.dictionary[b % many].as_py()))
                    key_ = (langs.dictionary[a // many].as_py(), *pair)
                    sums[key_] = sums.get(key_, 0) + value
                at = to
                if len(sums) > SUMS:
                    yield out()
                    sums.clear()
        yield out()

    by_term = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("sources"))
    return by_term.where(F.size("sources") > 1).select("lang", "sources").mapInArrow(stream, schema).groupBy("lang", "one", "two").agg(F.sum("both").alias("both"))


def audit(docs: DataFrame, least_docs: int = 30, smooth: int = 5, scale: int = 10**9, top: int = 50, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which terms.

    Part ``pair`` has every other source of the language with the sum of the differences
    of shares over all kept terms; part ``term`` has the ``top`` terms whose share is
    furthest above the language's. Ties go by the item's bytes. Null ``text``, ``lang`` and
    ``source`` count as empty strings. A group without terms has all its pairs; without
    kept terms all values are 0. Rows that repeat a ``doc_id`` are documents of their own. A
    very long text is indexed in one task. An empty table gives no rows. Only ``text``,
    ``lang`` and ``source`` are read, whatever other columns are called.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = write_table(_merged(_runs(rows, block), least_docs), "kept_terms")
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all_n"))
    groups = write_table(
        rows.select("lang", "source").distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("own_n", F.lit(0)) + smooth * F.coalesce("terms", F.lit(0))).alias("whole"))
        .select("*", F.coalesce(_share("0", "whole", smooth, scale), F.lit(0)).alias("absent")),
        "groups",
    )
    postings = kept.join(groups.select("lang", "source", "whole", "absent"), ["lang", "source"]).select("lang", "term", "source", "absent", _share("n", "whole", smooth, scale).alias("p"))
    postings = write_table(postings, "shares")

    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other_absent"))
    others = groups.select("lang", "source", "absent").join(other, "lang").where(F.col("source") != F.col("item"))
    shares = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    sided = write_table(_one_sided(shares, others.select("lang", "source", "item", "absent", "other_absent")), "one_sided")
    back = sided.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("own").alias("other"))
    both = _shared(postings)
    pairs = (
        sided.join(back, ["lang", "source", "item"]).join(groups.select("lang", "source", "terms"), ["lang", "source"])
        .withColumn("one", F.least("source", "item")).withColumn("two", F.greatest("source", "item"))
        .join(both, ["lang", "one", "two"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                (F.col("terms") * F.abs(F.col("absent") - F.col("other_absent")) + F.col("own") + F.col("other") + F.coalesce("both", F.lit(0))).alias("value"))
    )

    whole = langs.select("lang", (F.col("all_n") + smooth * F.col("terms")).alias("whole"))
    base = of_lang.join(whole, "lang").select("lang", "term", _share("n", "whole", smooth, scale).alias("q"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    above = postings.join(base, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(pairs).select(*RESULT).unionByName(ranked(above).where(F.col("rank") <= top).select(*RESULT))
