"""Toxicity by a learned lexicon, caught misspellings and the context of every hit.

A lexicon of words and word stems is learned from labelled documents: terms whose rate
in toxic texts stands out from that in clean ones. It is kept as a trie. Words are
read by the intersection of the trie with the automaton of Levenshtein distance one
(a swap of neighbours counts as one edit); the intersection is made deterministic
state by state as words ask for it, so a word costs one look-up per letter.

Hits are scored in their context: the share of all words, the densest window, and
apart from these the hits inside quotation marks. A logistic model over these features
is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.sampling import first_by_hash
from loadscope.llm.workers import tidied
from loadscope.session import write_table

#: Most labelled documents to learn from, and most terms to learn.
TRAIN_ROWS = 20_000
TERMS = 1_000
STEMS = range(4, 9)
#: Letters from which a misspelling counts.
FUZZY_LENGTH = 5
WINDOW = 40
CACHE_WORDS = 150_000
#: Terms that a task counts before it passes them on.
FLUSH_TERMS = 50_000
CACHE_STATES = 200_000

_WORD = re.compile(r"[^\W_]+")
_MARKS = '"“”«»„\n'
_MARK = re.compile(f"[{_MARKS}]")
_DIGITS = str.maketrans("013457", "oieast")
_NONE, _EXACT, _FUZZY = 0, 1, 2


def held_out(doc_id: str) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


class Automaton:
    """The lexicon's trie met with the Levenshtein automaton; terms that end in ``*`` are stems."""

    def __init__(self, weights: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.long: set[int] = set()
        for term, weight in weights.items():
            letters, node = term.rstrip("*"), 0
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.stem if term.endswith("*") else self.word)[node] = weight
            if len(letters) >= FUZZY_LENGTH:
                self.long.add(node)
        self._clear()

    def _clear(self) -> None:
        self.names: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state(frozenset([(0, 0, "")]), 0.0)

    def _state(self, places: frozenset, found: float) -> int:
        """Number of a state: places in the trie with the edits made, and the best stem passed."""
        key = (places, found)
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(key)
        return self.names[key]

    def _move(self, state: int, c: str) -> int:
        places, found = self.sets[state]
        out = set()
        for node, edits, owed in places:
            if owed:  # the second letter of a swap
                if c == owed:
                    out.add((node, 1, ""))
                continue
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, edits, ""))
                if edits == 0:
                    found = max(found, self.stem.get(child, 0.0))
            if edits == 0:
                out.add((node, 1, ""))
                for other, below in self.children[node].items():
                    out.add((below, 1, ""))
                    after = self.children[below].get(c)
                    if after is not None:
                        out.add((after, 1, ""))
                        out.add((after, 1, other))
        return self._state(frozenset(out), found)

    def read(self, word: str) -> tuple[int, float]:
        """Kind and weight of a word; no hit is ``(0, 0.0)``."""
        if len(self.sets) > CACHE_STATES:
            self._clear()
        state, moves = self.start, self.moves
        for c in word:
            to = moves.get((state, c))
            if to is None:
                to = moves[state, c] = self._move(state, c)
            state = to
            if not self.sets[state][0]:
                break
        places, found = self.sets[state]
        exact, fuzzy = found, 0.0
        for node, edits, owed in places:
            if owed:
                continue
            if edits == 0:
                exact = max(exact, self.word.get(node, 0.0))
                for c, below in self.children[node].items():  # the term's last letter is missing
                    if below in self.long and below in self.word:
                        fuzzy = max(fuzzy, self.word[below])
            elif node in self.long:
                fuzzy = max(fuzzy, self.word.get(node, 0.0))
        if exact:
            return _EXACT, exact
        return (_FUZZY, fuzzy) if fuzzy else (_NONE, 0.0)


class Quotations:
    """Places of line ends and quotation marks of a text, found once."""

    def __init__(self, text: str):
        places: dict[str, list[int]] = {c: [] for c in _MARKS}
        for m in _MARK.finditer(text):
            places[m[0]].append(m.start())
        self.at = places

    def holds(self, start: int) -> bool:
        """Whether a quotation is open at a place of its line and closed after it."""
        ends = self.at["\n"]
        line = bisect_left(ends, start)
        low, high = ends[line - 1] + 1 if line else 0, ends[line] if line < len(ends) else 1 << 62

        def last(mark: str) -> int:
            found = self.at[mark]
            k = bisect_left(found, start)
            return found[k - 1] if k and found[k - 1] >= low else -1

        def follows(mark: str) -> bool:
            found = self.at[mark]
            k = bisect_left(found, start)
            return k < len(found) and found[k] < high

        straight = self.at['"']
        if (bisect_left(straight, start) - bisect_left(straight, low)) % 2 and follows('"'):
            return True
        return any(last(a) > last(b) and follows(b) for a, b in ("“”", "«»", "„“"))


class Reader:
    """Features of a text; holds the cache of a worker."""

    def __init__(self, weights: dict[str, float]):
        self.automaton = Automaton(weights)
        self.hit: dict[str, tuple[int, float] | int] = {}

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        words = _WORD.findall(lower)
        hits = list(map(self.hit.get, words))
        if None in hits:
            new = {w for w, h in zip(words, hits, strict=True) if h is None}
            if len(self.hit) > CACHE_WORDS:
                self.hit.clear()
                new = set(words)
            for w in new:
                kind, weight = self.automaton.read(w)
                if not kind and not w.isalpha() and not w.isdigit():
                    kind, weight = self.automaton.read(w.translate(_DIGITS))
                    kind = _FUZZY if kind else kind
                self.hit[w] = (kind, weight) if kind else 0
            hits = list(map(self.hit.__getitem__, words))
        at = [k for k, h in enumerate(hits) if h]
        exact = fuzzy = quoted = densest = 0.0
        count = 0
        if at:
            quotations = Quotations(lower) if _MARK.search(lower.replace("\n", "")) else None
            spans = [m.start() for m in _WORD.finditer(lower)] if quotations else None
            weights = []
            for k in at:
                kind, weight = hits[k]
                if quotations and quotations.holds(spans[k]):
                    quoted += weight
                    weight = 0.0
                elif kind == _EXACT:
                    exact += weight
                    count += 1
                else:
                    fuzzy += weight
                weights.append(weight)
            low = 0
            total = 0.0
            for high, k in enumerate(at):
                total += weights[high]
                while at[low] <= k - WINDOW:
                    total -= weights[low]
                    low += 1
                densest = max(densest, total)
        n = len(words)
        distinct = len({words[k] for k in at})
        return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), np.log1p(densest), np.log1p(100 * (exact + fuzzy) / max(n, 1)), np.log1p(distinct), float(count > 0), np.log1p(n) / 5]


FEATURES = 8


@dataclass
class Model:
    """Lexicon, and the logistic model over the features."""

    weights: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    slope: np.ndarray
    intercept: float


def _terms(labelled: DataFrame) -> DataFrame:
    """``term, toxic, occurrences, documents`` of words and stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(t, y, n, d) for (t, y), (n, d) in counts.items()]
            counts.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["term", "toxic", "occurrences", "documents"]
            )

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own: Counter = Counter()
                for w, n in Counter(_WORD.findall((text or "").lower())).items():
                    own[w] += n
                    for k in STEMS:
                        if len(w) > k:
                            own[w[:k] + "*"] += n
                for t, n in own.items():
                    c = counts.setdefault((t, toxic), [0, 0])
                    c[0] += n
                    c[1] += 1
                if len(counts) > FLUSH_TERMS:
                    yield flush()
        yield flush()

    return (
        labelled.mapInArrow(tidied(run), "term string, toxic bigint, occurrences bigint, documents bigint")
        .groupBy("term").agg(*(F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0)).alias(f"{c[0]}{y}") for y in (0, 1) for c in ("occurrences", "documents")))
    )


def _lexicon(labelled: DataFrame, words: tuple[float, float]) -> dict[str, float]:
    """At most ``TERMS`` terms whose rate in toxic texts stands out, with the logarithm of the ratio of rates."""
    n0, n1 = (max(1.0, x) for x in words)
    expected = (F.col("o0") + F.col("o1")) * F.lit(n1 / (n0 + n1))
    against = (F.col("o0") + F.col("o1")) - expected
    part = lambda o, e: F.when(F.col(o) > 0, F.col(o) * F.log(F.col(o) / e)).otherwise(0.0)
    ratio = F.log((F.col("o1") + 0.5) / F.lit(n1)) - F.log((F.col("o0") + 0.5) / F.lit(n0))
    found = (
        _terms(labelled).where("d1 >= 4")
        .select("term", "o1", (2 * (part("o1", expected) + part("o0", against))).alias("g"), ratio.alias("ratio"))
        .where("g >= 25 and ratio >= 1.5").orderBy(F.desc("g"), "term").limit(TERMS).collect()
    )
    kept: dict[str, float] = {}
    seen: list = []
    for r in sorted(found, key=lambda r: (-len(r.term.rstrip("*")), r.term.endswith("*"), r.term)):
        stem = r.term.rstrip("*")
        # a stem that one longer term explains says nothing more
        if r.term.endswith("*") and any(x.term.startswith(stem) and x.o1 >= 0.7 * r.o1 for x in seen):
            continue
        seen.append(r)
        kept[r.term] = float(min(8.0, r.ratio))
    return kept


def _featured(docs: DataFrame, weights: dict[str, float], *extra: str) -> DataFrame:
    names = ["doc_id", *extra]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            texts = batch.column("text")
            flat = np.zeros((len(texts), FEATURES))
            for at in range(0, len(texts), 256):
                for k, t in enumerate(texts.slice(at, 256).to_pylist()):
                    flat[at + k] = reader.features(t or "")
            at = pa.array(np.arange(len(texts) + 1) * FEATURES, pa.int32())
            columns = [batch.column(c).cast(pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(at, pa.array(flat.ravel()))], [*names, "x"])

    schema = ", ".join([*(f"{c} bigint" for c in names), "x array<double>"])
    return docs.select("text", *names).mapInArrow(tidied(run), schema)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps, with a small penalty on the slopes."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], 1.0)
    penalty[-1] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta[:-1], float(beta[-1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents, the first by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = first_by_hash(known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")), "doc_id", rows)
    # at most ``rows`` pairs of numbers are broadcast
    sample = write_table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")
    words = dict(sample.groupBy("toxic").agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))).cast("double")).collect())
    weights = _lexicon(sample.select("text", "toxic"), (words.get(0, 0.0), words.get(1, 0.0)))
    pairs = _featured(sample, weights, "toxic").select("toxic", "x").collect()
    if not pairs:
        return Model(weights, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), -10.0)
    x, y = np.array([r.x for r in pairs]), np.array([float(r.toxic > 0) for r in pairs])
    return Model(weights, *_fit(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` from the texts alone."""
    at = lambda k: (F.col("x")[k] - float(model.mean[k])) / float(model.scale[k]) * float(model.slope[k])
    logit = sum((at(k) for k in range(FEATURES)), F.lit(model.intercept))
    return _featured(docs, model.weights).select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Learned from labels of rows that are not held out; a document with several labels
    is toxic if one says so, and labels without a document or value are ignored. Null
    and empty texts have the score of a text without hits; without any label all
    scores are near 0. Rows that repeat an id are scored each by its own text.
    Columns other than ``doc_id``, ``text`` and ``toxic`` are not read.
    """
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold, with all columns; every row is judged by its own text."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.weights)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                x = np.array([reader.features(t or "") for t in some.column("text").to_pylist()])
                logit = ((x - m.mean) / m.scale) @ m.slope + m.intercept
                yield some.filter(pa.array(1 / (1 + np.exp(-logit)) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
