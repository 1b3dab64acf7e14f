import random
import time
import zlib

from pyspark.sql import functions as F

from loadscope.llm import toxicity as T


def distance(a, b):
    """Levenshtein distance in which a swap of neighbours is one edit."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_like_brute_force():
    rng = random.Random(1)
    terms = {"idiot": 3.0, "stupid": 2.0, "scum": 5.0, "stupor": 1.0, "loser": 4.0, "achlich*": 2.5}
    automaton = T.Automaton(terms)
    letters = "abcdeilmoprstuch"
    words = set()
    for t in terms:
        t = t.rstrip("*")
        for _ in range(400):
            w = list(t)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(w)) if w else 0
                rng.choice([lambda: w.pop(k) if w else None, lambda: w.insert(k, rng.choice(letters)), lambda: w.__setitem__(k, rng.choice(letters)) if w else None,
                            lambda: w.__setitem__(slice(k, k + 2), w[k : k + 2][::-1])])()
            words.add("".join(w) + rng.choice(["", "", "ung"]))
    for w in words:
        exact = max([x for t, x in terms.items() if t == w or (t.endswith("*") and w.startswith(t[:-1]))], default=0)
        fuzzy = max([x for t, x in terms.items() if not t.endswith("*") and len(t) >= T.FUZZY_LENGTH and distance(t, w) == 1], default=0)
        want = (T._EXACT, exact) if exact else (T._FUZZY, fuzzy) if fuzzy else (T._NONE, 0.0)
        assert automaton.read(w) == want, w


def test_quotations_and_windows():
    reader = T.Reader({"idiot": 3.0})
    plain, quoted = reader.features("you are an idiot, he said"), reader.features('they wrote "you are an idiot" there')
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0
    near, far = reader.features("idiot idiot " + "x " * 200), reader.features("idiot " + "x " * 200 + "idiot")
    assert near[0] == far[0] and near[3] > far[3]
    assert reader.features("an 1diot and an idoit")[1] > 0


def corpus(n):
    rng = random.Random(n)
    calm, bad = [f"{a}{b}" for a in ("lo", "mi", "ter", "san", "ka") for b in ("ra", "ne", "vo", "tu", "pel", "dor")], ["idiot", "worthless", "pathetic", "moron"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randrange(20, 90))]
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_labels_are_predicted(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxic", F.lit("clash")).withColumn("x", F.lit(0))
    got = {r.doc_id: r for r in T.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i, _ in labels)
    hidden = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in hidden) >= 0.97 * len(hidden)
    kept = T.clean(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_given_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    both = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in both if r.toxic]
    clean = [r.predicted for r in both if not r.toxic]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (3, "idiot " * 50_000), (4, "calm words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (99, 1)], "doc_id bigint, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in T.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert T.toxicity(docs.limit(0), labels).collect() == []


def test_a_full_cache_changes_nothing(monkeypatch):
    texts = ["one idiot two", "three idiot one", "four five one two", "one two idiot"]
    want = [T.Reader({"idiot": 2.0}).features(t) for t in texts]
    monkeypatch.setattr(T, "CACHE_WORDS", 2)
    reader = T.Reader({"idiot": 2.0})
    assert [reader.features(t) for t in texts] == want


def test_quotations_like_a_walk_along_the_line():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choices(['"', "“", "”", "«", "»", "„", "\n", "a", "b "], k=rng.randrange(40)))
        held = T.Quotations(text)
        for start in range(len(text)):
            low, high = text.rfind("\n", 0, start) + 1, text.find("\n", start)
            before, after = text[low:start], text[start : high if high >= 0 else len(text)]
            want = before.count('"') % 2 == 1 and '"' in after or any(before.rfind(a) > before.rfind(b) and b in after for a, b in ("“”", "«»", "„“"))
            assert held.holds(start) == want


def test_many_hits_on_one_line_take_linear_time():
    text = '"' + "idiot " * 100_000 + '"'
    start = time.process_time()
    T.Reader({"idiot": 2.0}).features(text)
    assert time.process_time() - start < 10
