"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two first-order models over the characters of candidate strings, one of random strings
and one of ordinary identifiers, are compared by their log-likelihood ratio. They are
trained from labelled samples: in bounded numbers of documents, values of pattern
matches are random strings and all other long runs are identifiers. Counts
of character pairs, of which there are at most ``len(ALPHABET) ** 2`` per model, are all
that leaves the cluster. Everything runs as column expressions.

Positions come from splitting a text at its matches: the lengths of the parts and of
the matches add up to starts and ends in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.sampling import first_by_hash

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The patterns, the group that holds the value and its least length.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
LEAST = {"assign": 12, "access": 18}
MARKOV = "markov"
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"
_IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"
#: Documents that each model is trained from, the first by a hash of the id.
TRAIN_ROWS = 5_000
#: Added to the count of every pair of identifiers, and of random strings, which are known to be nearly even.
SMOOTHING = (0.5, 4.0)
#: Least length and log-likelihood ratio of a string, in all and per pair of characters.
LEAST_LENGTH = 12
LEAST_TOTAL, LEAST_MEAN = 15.0, 0.6

_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, rank: int, might: Column | None = None) -> Column:
    """Spans of all matches with their strings; texts without any cost one search."""
    some = text.rlike(pattern) if might is None else might & text.rlike(pattern)
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    empty = F.array().cast(_SPAN)
    spans = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"),
                (acc["at"] + s["gap"] + F.length(s["m"])).alias("end"), s["m"].alias("value"),
            ))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(some, spans).otherwise(empty)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text, assign, access, hex``: the pattern spans of every text; null texts count as empty."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = _matches(text, ASSIGN, 0, text.contains("=") | text.contains(":"))
    return rows.select(
        "doc_id", "text",
        F.filter(assign, lambda s: F.length(value(s["value"])) >= LEAST["assign"]).alias("assign"),
        F.filter(_matches(text, ACCESS, 1, text.contains("AKIA")), lambda s: F.length(s["value"]) >= LEAST["access"]).alias("access"),
        _matches(text, HEX, 2).alias("hex"),
    )


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring characters of the alphabet, by label."""
    pair = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))
    pairs = strings.where(F.length("s") > 1).select("random", F.explode(pair).alias("pair"))
    return pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n"))


def samples(found: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``random, s``: matched values from at most ``rows`` documents with pattern matches, other runs from as many of all.

    Values of hexadecimal digits alone are left out: they would make all other pairs of
    characters look less random, and so are other runs of small and capital letters with
    digits, which nobody has labelled. Only strings, no texts, meet in the task that cuts the sample.
    """
    spans = F.concat("assign", "access", "hex")
    values = F.transform(spans, lambda s: F.when(s["rank"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    matched = found.where(F.size(spans) > 0).select("doc_id", F.filter(values, lambda v: ~v.rlike("^[0-9a-f]*$")).alias("s"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    runs = F.regexp_extract_all(rest, F.lit(_IDENTIFIER), F.lit(0))
    plain = F.filter(runs, lambda v: ~(v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")))
    others = found.select("doc_id", plain.alias("s"))
    chosen = [first_by_hash(part, "doc_id", rows).select(F.lit(k).alias("random"), F.explode("s").alias("s")) for k, part in ((1, matched), (0, others))]
    return chosen[0].unionByName(chosen[1])


def ratios(strings: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against identifier, of every pair of characters in the order of the alphabet."""
    size = len(ALPHABET)
    counts = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    for r in _pairs(strings).collect():
        counts[r.random][ALPHABET.index(r.pair[0])][ALPHABET.index(r.pair[1])] += r.n
    out = []
    for a in range(size):
        whole = [sum(c[a]) + more * size for c, more in zip(counts, SMOOTHING)]
        logs = [[math.log((c[a][b] + more) / all_) for b in range(size)] for c, more, all_ in zip(counts, SMOOTHING, whole)]
        out += [r - i for i, r in zip(*logs)]
    return out


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _random_part(run: Column, table: Column) -> Column:
    """The random string in a run of at least two characters as a span, or NULL.

    That is the whole run where its log-likelihood ratio is high enough, in all and per
    pair; otherwise the stretch that most exceeds the least ratio per pair, if it is long
    and high enough.
    """
    value, pairs = run["value"], F.length(run["value"]) - 1
    places = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    scores = _let(
        places,
        lambda p: F.zip_with(F.slice(p, F.lit(1), pairs), F.slice(p, F.lit(2), pairs), lambda a, b: F.get(table, a * len(ALPHABET) + b)),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0.0).alias("total"), F.lit(0.0).alias("now"), F.lit(0).alias("since"),
        F.lit(0.0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"),
    )

    def longer(acc: Column, score: Column) -> Column:
        """The stretch that ends here goes on as long as it exceeds the least ratio."""
        goes_on, gain = acc["now"] > 0, score - LEAST_MEAN
        now, since = F.when(goes_on, acc["now"] + gain).otherwise(gain), F.when(goes_on, acc["since"]).otherwise(acc["at"])
        better = now > acc["best"]
        return F.struct(
            (acc["at"] + 1).alias("at"), (acc["total"] + score).alias("total"), now.alias("now"), since.alias("since"),
            F.when(better, now).otherwise(acc["best"]).alias("best"),
            F.when(better, since).otherwise(acc["first"]).alias("first"), F.when(better, acc["at"] + 1).otherwise(acc["last"]).alias("last"),
        )

    def span(found: Column) -> Column:
        whole = (found["total"] >= LEAST_TOTAL) & (found["total"] >= LEAST_MEAN * pairs)
        length = found["last"] - found["first"]
        part = (length + 1 >= LEAST_LENGTH) & (found["best"] + LEAST_MEAN * length >= LEAST_TOTAL)
        inner = F.struct(
            (run["start"] + found["first"]).alias("start"), run["rank"].alias("rank"), (run["start"] + found["last"] + 1).alias("end"),
            F.substring(value, found["first"] + 1, length + 1).alias("value"),
        )
        return F.when(whole, run).when(part, inner)

    return _let(F.aggregate(scores, start, longer), span)


def secrets(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, spans, base``: all spans as ``start, rank, end, value``, sorted; ``base`` counts those of the patterns.

    Ranks follow ``assign, access, hex, markov``. A string that the models find must not
    overlap a pattern match; it has at least ``LEAST_LENGTH`` characters and is a whole run of
    them or the best stretch of a longer one, one a run. Null and empty texts have no spans; rows that repeat an id
    are scanned each; an empty table gives no rows; texts of any length are scanned whole. Only ``doc_id`` and ``text`` are read.
    """
    found = scan(docs)
    numbers = ",".join(f"{x:.6f}" for x in ratios(samples(found, rows)))
    table = F.split(F.lit(numbers), ",").cast("array<double>")
    base = F.concat("assign", "access", "hex")
    free = lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    parts = F.transform(_matches(F.col("text"), _RUN, 3), lambda c: _random_part(c, table))
    runs = F.filter(parts, lambda c: c.isNotNull() & free(c))
    out = found.select("doc_id", "text", base.alias("base")).select("doc_id", F.array_sort("base").alias("base"), runs.alias("runs"))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", "runs")).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, MARKOV)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document the number of spans of every kind, a digest of the pattern spans, and all spans."""
    found = secrets(docs, rows)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(3).alias("n_markov"),
    )
