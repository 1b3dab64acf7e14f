import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from loadscope.functions.text import ChatTemplate, token_count
from loadscope.operators import datasets

TEMPLATE = ChatTemplate()
TURNS = "conv_id bigint, turn int, `from` string, value string"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(
        [(1, 0, "system", "be kind"), (1, 1, "human", "hi"), (1, 2, "gpt", "hello there"),
         (2, 1, "gpt", "b"), (2, 0, "human", "a"),
         *[(3, t, "human", "w " * 50) for t in range(40)]],
        TURNS,
    )


@pytest.fixture(scope="module")
def counted(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate([1, 5, 5, 9, 100])], "id int, token_count int")


def test_lengths_match_the_rendered_texts(turns):
    lengths = datasets.conversation_lengths(turns, TEMPLATE, specials=1)
    texts = datasets.render_conversations(turns, lengths, TEMPLATE)
    for r in texts.withColumn("c", token_count(F.col("text"), 1)).collect():
        assert r.c == r.token_count
    shown = {r.conv_id: r.text for r in texts.collect()}
    assert shown[2] == "<|im_start|>system\n<|im_end|>\n<|im_start|>human\na<|im_end|>\n<|im_start|>gpt\nb<|im_end|>\n"
    assert shown[1].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>human\nhi")


def test_only_capped_conversations_are_built(turns):
    capped = datasets.length_cap(datasets.conversation_lengths(turns, TEMPLATE), 100)
    assert sorted(r.conv_id for r in datasets.render_conversations(turns, capped, TEMPLATE).collect()) == [1, 2]
    with pytest.raises(ValueError):
        datasets.conversation_lengths(turns, ChatTemplate(end="<end>"))


def test_cap_is_strict(counted):
    assert [r.token_count for r in datasets.length_cap(counted, 9).collect()] == [1, 5, 5]


def test_qa(spark):
    df = spark.createDataFrame(
        [(1, "open_qa", "", "q", "a"), (2, "x_closed_qa", "", "q", "a"), (3, "open_qa", "c", "q", "a"), (4, "other", "", "q", "a")],
        "id int, category string, context string, instruction string, response string",
    )
    kept = datasets.qa_only(df)
    assert sorted(r.id for r in kept.collect()) == [1, 2]
    text = datasets.templated_exchanges(kept, TEMPLATE).first().text
    assert text == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert "text" not in datasets.instruct_projection(datasets.templated_exchanges(kept, TEMPLATE)).columns


def test_first_n(counted):
    assert [r.id for r in datasets.first_n(counted, "id", 2).orderBy("ordinal").collect()] == [0, 1]
    shuffled = [r.id for r in datasets.first_n(counted, "id", 3, seed=4).orderBy("ordinal").collect()]
    assert len(set(shuffled)) == 3
    assert datasets.first_n(counted, "id", 9).count() == 5
    with pytest.raises(PySparkException):
        datasets.first_n(counted, "id", 9, strict=True).collect()


def test_statistics(counted):
    assert rows(datasets.length_stats(counted)) == [(5, 100, 1, 24.0)]
    shares = {r.threshold: r.percentage for r in datasets.threshold_shares(counted, (5, 9, 200)).collect()}
    assert shares == {5: 20.0, 9: 60.0, 200: 100.0}
    empty = counted.where("false")
    assert {r.percentage for r in datasets.threshold_shares(empty).collect()} == {None}
    assert rows(datasets.length_stats(empty)) == [(0, None, None, None)]


def test_histogram(spark, counted):
    out = datasets.histogram(counted, 4, cutoff=7).orderBy("bin").collect()
    want, edges = np.histogram([1, 5, 5, 9, 100], bins=4)
    assert [r.entries for r in out] == list(want) and out[0].cutoff == 7
    assert np.allclose([r.bin_low for r in out], edges[:-1])
    same = spark.createDataFrame([(7,), (7,)], "token_count int")
    want, edges = np.histogram([7, 7], bins=50)
    assert [r.entries for r in datasets.histogram(same).orderBy("bin").collect()] == list(want)
    assert sum(r.entries for r in datasets.histogram(counted.where("false")).collect()) == 0


def test_fixed_length(spark):
    out = datasets.fixed_length_texts(spark.range(3), 17)
    assert {len(r.text.split()) for r in out.collect()} == {17}
    with pytest.raises(PySparkException):
        datasets.fixed_length_texts(spark.range(3), 17, word="two words").collect()
