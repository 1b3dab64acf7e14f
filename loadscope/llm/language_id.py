"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A word's probability in a language is the sum, over every way to cut it into pieces
of the vocabulary, of the product of the pieces' probabilities; the forward algorithm
gives it without listing the ways. The probabilities are learned by expectation
maximisation from the words of all labelled documents: words are counted in Spark,
each pass over the distinct words adds up expected pieces, and only those, at most
one number per piece and language, come to the driver.

Words are runs of letters, lower-cased and opened by the vocabulary's word mark.
Words of equal length are computed together.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.session import write_table

#: Longer runs of letters are scored in stretches of this many.
STRETCH = 24
#: Probability of a letter that is no piece, in every language.
UNKNOWN = 1e-7
SMOOTHING = 0.05
PASSES = 2
#: Words a worker collects or keeps at a time.
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def held_out(doc_id: str) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    if words and not any(w.isalpha() for w in words):
        words = ["".join(c for c in w if c.isalpha()) for w in words]
        words = [w for w in words if w]
    return words


_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits that tell hashes of pieces from most others.
_SEEN_BITS = 20


def _codes(words: list[str], n: int) -> np.ndarray:
    """``[word, place]``: code points of words of equal length, one added."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """The vocabulary, and the pieces at every place of words of equal length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        plain = [n for k, n in enumerate(names) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)) and len(n) <= STRETCH + 1]
        self.of = {n: k for k, n in enumerate(plain)}
        self.size = len(plain)
        self.longest = max(map(len, plain))
        self.lengths = np.array(list(map(len, plain)))
        self.letters = np.zeros((self.size, self.longest), dtype=np.uint64)
        keys = np.zeros(self.size, dtype=np.uint64)
        for n in range(1, self.longest + 1):
            rows = np.flatnonzero(self.lengths == n)
            codes = _codes([plain[k] for k in rows.tolist()], n)
            self.letters[rows, :n] = codes
            for k in range(n):
                keys[rows] = (keys[rows] + codes[:, k]) * _BASE
        keys = _stirred(keys)
        self.ids = np.argsort(keys, kind="stable")
        self.keys = keys[self.ids]
        self.seen = np.zeros(1 << _SEEN_BITS, dtype=bool)
        self.seen[keys >> np.uint64(64 - _SEEN_BITS)] = True

    def places(self, words: list[str]) -> np.ndarray:
        """``[word, from, length - 1]``: id of the piece, ``size`` where there is none, ``size + 1`` for an unknown letter.

        Substrings of one length are hashed for all words at once. A table of bits tells
        most that are no piece, the sorted hashes find the others, and the letters decide.
        """
        n = len(words[0])
        reach = min(n, self.longest)
        out = np.full((len(words), n, reach), self.size, dtype=np.int32)
        codes = _codes(words, n)
        raw = np.zeros((len(words), n), dtype=np.uint64)
        for size in range(1, reach + 1):
            raw = (raw[:, : n - size + 1] + codes[:, size - 1 :]) * _BASE
            key = _stirred(raw)
            row, at = np.nonzero(self.seen[key >> np.uint64(64 - _SEEN_BITS)])
            found = key[row, at]
            place = np.minimum(np.searchsorted(self.keys, found), self.size - 1)
            hit = self.keys[place] == found
            row, at, piece = row[hit], at[hit], self.ids[place[hit]]
            same = self.lengths[piece] == size
            for k in range(size):
                same &= self.letters[piece, k] == codes[row, at + k]
            out[row[same], at[same], size - 1] = piece[same]
        single = out[:, :, 0]
        single[single == self.size] = self.size + 1
        return out


def _forward(places: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``[place, word, ...]``: probability of all segmentations of the word up to a place."""
    count, n, reach = places.shape
    alpha = np.zeros((n + 1, count, *table.shape[1:]))
    alpha[0] = 1
    for j in range(1, n + 1):
        for i in range(max(0, j - reach), j):
            alpha[j] += alpha[i] * table[places[:, i, j - i - 1]]
    return alpha


def _grouped(words: list[str]) -> Iterator[list[int]]:
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for rows in by_length.values():
        for at in range(0, len(rows), 4096):
            yield rows[at : at + 4096]


def _stretches(word: str) -> list[str]:
    return [_MARK + word[:STRETCH], *(word[k : k + STRETCH] for k in range(STRETCH, len(word), STRETCH))]


def _tables(probability: np.ndarray) -> np.ndarray:
    """Rows by piece, with the rows for no piece and for an unknown letter."""
    rows = probability.reshape(len(probability), -1)
    return np.vstack([rows, np.zeros((1, rows.shape[1])), np.full((1, rows.shape[1]), UNKNOWN)])


def log_likelihood(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """``[word, language]``."""
    parts, owner = [], []
    for k, w in enumerate(words):
        for s in _stretches(w):
            parts.append(s)
            owner.append(k)
    out = np.zeros((len(words), table.shape[1]))
    owner = np.array(owner)
    for rows in _grouped(parts):
        alpha = _forward(pieces.places([parts[k] for k in rows]), table)
        np.add.at(out, owner[rows], np.log(np.maximum(alpha[-1], 1e-300)))
    return out


def _expected(pieces: Pieces, table: np.ndarray, words: list[str], language: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``[piece, language]``: expected pieces of counted words, each in its language."""
    parts, owner = [], []
    for k, w in enumerate(words):
        for s in _stretches(w):
            parts.append(s)
            owner.append(k)
    languages = table.shape[1]
    total = np.zeros((len(table), languages))
    for rows in _grouped(parts):
        own = np.array(owner)[rows]
        places = pieces.places([parts[k] for k in rows])
        of, n = language[own], count[own]
        m, size, reach = places.shape
        chance = lambda i, j: table[places[:, i, j - i - 1], of]
        alpha, beta = np.zeros((size + 1, m)), np.zeros((size + 1, m))
        alpha[0] = beta[size] = 1
        for j in range(1, size + 1):
            for i in range(max(0, j - reach), j):
                alpha[j] += alpha[i] * chance(i, j)
        for i in range(size - 1, -1, -1):
            for j in range(i + 1, min(size, i + reach) + 1):
                beta[i] += beta[j] * chance(i, j)
        scale = n / np.maximum(alpha[size], 1e-300)
        for i in range(size):
            for j in range(i + 1, min(size, i + reach) + 1):
                share = alpha[i] * chance(i, j) * beta[j] * scale
                key = places[:, i, j - i - 1].astype(np.int64) * languages + of
                np.add.at(total.reshape(-1), key, share)
    return total


def _word_counts(labelled: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > CACHE_WORDS:
                    yield flush()
        yield flush()

    return labelled.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.path, self.languages, self.probability = path, languages, probability


def learn(labelled: DataFrame, path: str, passes: int = PASSES) -> Model:
    """Piece probabilities of every language from rows of ``text, lang`` without nulls."""
    words = write_table(_word_counts(labelled.select("text", "lang")), "words")
    languages = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]
    size = Pieces(path).size
    probability = np.full((size, max(1, len(languages))), 1.0 / size)
    number = {x: k for k, x in enumerate(languages)}
    context = labelled.sparkSession.sparkContext
    for _ in range(passes if languages else 0):
        shared = context.broadcast(probability)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, table = Pieces(path), _tables(shared.value)
            total = np.zeros_like(table)
            for batch in batches:
                found = batch.column("word").to_pylist()
                if found:
                    of = np.array([number[x] for x in batch.column("lang").to_pylist()])
                    total += _expected(pieces, table, found, of, batch.column("n").to_numpy().astype(float))
            piece, lang = np.nonzero(total[:-2])
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        found = words.mapInArrow(run, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        expected = np.full((size, len(languages)), SMOOTHING)
        expected[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
        probability = expected / expected.sum(axis=0, keepdims=True)
    return Model(path, languages, probability)


class Scorer:
    """Log-likelihoods of words; holds the cache of a worker."""

    def __init__(self, path: str, probability: np.ndarray):
        self.pieces, self.table = Pieces(path), _tables(probability)
        self.row_of: dict[str, int] = {}
        self.known = np.zeros((1 << 12, self.table.shape[1]))

    def totals(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Log-likelihood of every language for each list of words; None without words."""
        row_of = self.row_of
        new = list({w for ws in texts for w in ws if w not in row_of})
        if row_of and len(row_of) + len(new) > CACHE_WORDS:
            row_of.clear()
            new = list({w for ws in texts for w in ws})
        if new:
            first, last = len(row_of), len(row_of) + len(new)
            row_of.update(zip(new, range(first, last), strict=True))
            if last > len(self.known):
                self.known = np.vstack([self.known, np.zeros((max(len(self.known), last - len(self.known)), self.known.shape[1]))])
            self.known[first:last] = log_likelihood(self.pieces, self.table, new)
        return [self.known[list(map(row_of.__getitem__, ws))].sum(axis=0) if ws else None for ws in texts]


_scorers: dict[tuple[str, str], Scorer] = {}


def _scorer(path: str, probability: np.ndarray) -> Scorer:
    """The worker's scorer of a model; that of another model is dropped."""
    key = (path, hashlib.md5(probability.tobytes()).hexdigest())
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(path, probability)
    return _scorers[key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``: the likeliest language and its share of the likelihoods."""
    shared = docs.sparkSession.sparkContext.broadcast(model.probability)
    languages, path = model.languages, model.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(path, shared.value)
        for batch in batches:
            texts = batch.column("text")
            predicted, scores = [], []
            for at in range(0, len(texts), 256):
                part = [words_of(t) if t and languages else [] for t in texts.slice(at, 256).to_pylist()]
                for total in scorer.totals(part):
                    if total is None:
                        predicted.append("und")
                        scores.append(0.0)
                        continue
                    best = int(total.argmax())
                    predicted.append(languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from the rows that are not held out.

    ``path`` names the vocabulary file, which every executor must have. Texts that are
    null or have no letter are ``und`` with score 0, and so is every text when no row
    has a language. Equal likelihoods go to the first language by code point. Rows
    that repeat an id get the same answer each; a null id is not held out. Columns
    other than ``doc_id``, ``text`` and ``lang`` are not read, and ``lang`` only to learn.
    """
    labelled = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = predict(docs, learn(labelled, path))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
