import random

import corpus_pipeline
import pytest
from test_packing import check
from test_toxicity import corpus

from loadscope.llm import mixing, toxicity
from loadscope.session import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Toxic and clean documents, copies in other letter case, near copies, and odd rows."""
    rng = random.Random(6)
    rows, labels = corpus(150)
    texts = dict(rows)
    clean = [i for i, y in labels if not y]
    for k, i in enumerate(clean[:20]):
        rows.append((1000 + k, texts[i].upper()))
    for k, i in enumerate(clean[20:40]):
        words = texts[i].split()
        words[-1] = f"changed{k}"
        rows.append((2000 + k, " ".join(words)))
    rows += [(3000, None), (3001, ""), (3002, "short one")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, None, rng.choice(["a", "b", None]), len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def test_stages_like_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {i for i in text if scores[i] < 0.7}
    first = {}
    for i in sorted(kept):
        first.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in text[i] or ""), i)
    unique = sorted(first.values())
    parent = {i: i for i in unique}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(text[i]) for i in unique}
    for k, a in enumerate(unique):
        for b in unique[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = [kept, set(unique), {i for i in unique if root(i) == i}]
    assert len(want[0]) > len(want[1]) > len(want[2])
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:3], want, strict=True):
        docs = write_table(stage(spark, docs, tables), "stage")
        assert docs.columns == COLUMNS
        assert sorted(r.doc_id for r in docs.collect()) == sorted(ids)
    plan = {r.doc_id: r.copies if r.size else 1 for r in mixing.mix(docs).collect()}
    docs = write_table(corpus_pipeline.STAGES[3][1](spark, docs, tables), "stage")
    assert docs.columns == COLUMNS
    reads = [(r.doc_id, r.text) for r in docs.collect()]
    assert {i: sum(x == i for x, _ in reads) for i in plan} == plan
    check(corpus_pipeline.STAGES[4][1](spark, docs, tables).collect(), reads, 2048)
    assert corpus_pipeline.run(spark, tables).count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
