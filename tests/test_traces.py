import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from loadscope.catalog import ORACLES, QUERIES
from loadscope.functions.text import ChatTemplate, token_count, tokenizer_counter
from loadscope.operators import arrivals, ordered, traces
from loadscope.plans.burst_job import build_burst_trace
from loadscope.plans.trace_job import build_trace
from loadscope.sources import corpora

CONVERSATIONS = "conv_id bigint, conversations array<struct<`from`:string,value:string>>"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [
            (0, [("human", "a"), ("gpt", "b"), ("human", "c")]),
            (1, [("system", "s"), ("human", "a"), ("gpt", "b")]),
            (2, [("human", "only")]),
            (3, [("human", "x y"), ("gpt", "z")]),
            (4, [("gpt", "b"), ("human", "a")]),
            (5, []),
        ],
        CONVERSATIONS,
    )


@pytest.fixture(scope="module")
def pairs(spark):
    """Pair i has i + 1 tokens in all."""
    return spark.range(40).select(
        F.col("id"), F.lit("p").alias("prompt"), F.trim(F.repeat(F.lit("r "), F.col("id").cast("int"))).alias("response")
    )


def test_first_exchange_nested_and_by_turns(corpus):
    nested = sorted(rows(traces.first_exchange(corpus)))
    assert nested == [(0, "a", "b"), (3, "x y", "z")]
    assert sorted(rows(traces.first_exchange_of_turns(corpora.to_turns(corpus, "conv_id")))) == nested


def test_corpus_filter(spark):
    schema = "id int, model string, turn int, language string, conversation array<struct<role:string,content:string>>"
    good = [("user", "q"), ("assistant", "a")]
    df = spark.createDataFrame(
        [(1, "gpt-4", 1, "English", good), (2, "gpt-3.5", 1, "English", good), (3, "gpt-4", 2, "English", good),
         (4, "gpt-4", 1, "French", good), (5, "gpt-4", 1, "English", good[:1]), (6, "gpt-4", 1, "English", good[::-1])],
        schema,
    )
    assert rows(traces.filter_corpus(df, strict=False)) == [(1, "q", "a")]
    assert sorted(r.id for r in traces.corpus_violations(df).collect()) == [5, 6]
    with pytest.raises(PySparkException):
        traces.filter_corpus(df).collect()


def test_template_then_blank(pairs):
    template = ChatTemplate("[", "|", "]")
    shown = traces.prepare_prompts(pairs, template=template).first()
    assert shown.prompt == "[user|p][assistant|"
    assert traces.prepare_prompts(pairs, template=template, no_prompt=True).first().prompt == ""


def test_token_count(spark):
    df = spark.createDataFrame([("",), ("  a\tb\nc d ",), (None,)], "x string")
    assert [r[0] for r in df.select(token_count(F.col("x"))).collect()] == [0, 3, 0]
    assert df.select(token_count(F.col("x"), 2)).first()[0] == 2
    letters = tokenizer_counter(lambda: lambda texts: [len(t) for t in texts])
    assert [r[0] for r in df.select(letters(F.col("x"))).collect()] == [0, 10, 0]


def test_cap_is_inclusive_and_first_survivors_are_taken(pairs):
    shuffled = [r.id for r in ordered.hash_rank(pairs, F.col("id"), 3, "r").orderBy("r").collect()]
    want = [i for i in shuffled if i + 1 <= 20][:8]
    for parts in (1, 4, 16):
        got = traces.sample_entries(pairs.repartition(parts), "id", 8, 20, 3).orderBy("ordinal").collect()
        assert [r.id for r in got] == want and [r.ordinal for r in got] == list(range(8))
    few = traces.sample_entries(pairs, "id", 100, 5, 3)
    assert few.count() == 5  # fewer survivors than asked for


def test_candidate_cap(pairs):
    shuffled = [r.id for r in ordered.hash_rank(pairs, F.col("id"), 3, "r").orderBy("r").collect()]
    want = [i for i in shuffled[:12] if i + 1 <= 20][:4]
    got = traces.sample_entries(pairs, "id", 4, 20, 3, candidates=12).orderBy("ordinal").collect()
    assert [r.id for r in got] == want
    with pytest.raises(PySparkException):
        traces.sample_entries(pairs, "id", 4, 20, 3, candidates=41).collect()


def test_advancing_and_gap_joins_differ(spark, pairs):
    shuffled = [r.id for r in ordered.hash_rank(pairs, F.col("id"), 3, "r").orderBy("r").collect()]
    cap = 20
    assert any(i + 1 > cap for i in shuffled[:6])  # an over-long pair among the first
    times = spark.range(6).select(F.col("id").alias("ordinal"), (F.col("id") * 1.5).alias("arrival_time"))
    advancing = traces.with_arrivals(traces.sample_entries(pairs, "id", 6, cap, 3), times).orderBy("ordinal").collect()
    assert [r.id for r in advancing] == [i for i in shuffled if i + 1 <= cap][:6]
    assert [r.arrival_time for r in advancing] == [0.0, 1.5, 3.0, 4.5, 6.0, 7.5]
    events = spark.range(6).select((F.col("id") + 100).alias("event"), (F.col("id") * 1.5).alias("at"))
    gap = traces.attach_pairs(events, pairs, "id", cap, 3, order=["at", "event"]).orderBy("ordinal").collect()
    assert [r.response_length for r in gap] == [i if i + 1 <= cap else 0 for i in shuffled[:6]]
    assert [r.prompt for r in gap] == ["p" if i + 1 <= cap else "empty" for i in shuffled[:6]]


def test_more_rows_than_pairs(spark, pairs):
    events = spark.range(41).select(F.col("id").alias("event"), F.col("id").alias("at"))
    with pytest.raises(PySparkException):
        traces.attach_pairs(events, pairs, "id", 50, 3, order=["at", "event"]).collect()
    loose = traces.attach_pairs(events, pairs, "id", 50, 3, order=["at", "event"], strict=False)
    assert loose.where("prompt = 'empty'").count() == 1 and loose.count() == 41


def test_schedule_shorter_than_trace_raises(spark, pairs):
    entries = traces.sample_entries(pairs, "id", 6, 50, 3)
    times = spark.range(5).select(F.col("id").alias("ordinal"), F.lit(1.0).alias("arrival_time"))
    with pytest.raises(PySparkException):
        traces.with_arrivals(entries, times).collect()


def test_metadata_and_warmup(spark, pairs):
    entries = traces.with_lengths(pairs.where("id in (1, 2, 6)"))
    m = traces.metadata(entries, "poisson", 2).first()
    assert (m.max_total_length, m.total_tokens, m.avg_total_length, m.avg_entries_per_partition) == (7, 12, 4.0, 3.0)
    assert (m.min_response_length, m.max_response_length, m.trace_type, m.arrival_rate) == (1, 6, "poisson", 2.0)
    assert traces.metadata(entries.where("false")).first().max_total_length is None
    assert traces.count_above(entries, 3).first().num_above == 1  # strictly above
    warm = traces.warmup_entries(spark, 2).collect()
    assert [r.ordinal for r in warm] == [-2, -1] and {r.arrival_time for r in warm} == {0.0}


@pytest.mark.parametrize("kind", ["offline", "poisson", "replay"])
def test_build_trace(spark, pairs, kind):
    log = spark.range(2000).select((F.col("id") * 10_000 + 5).alias("t_us"))
    entries, metadata = build_trace(
        pairs, "id", 10, 30, 5, trace_type=kind, arrival_rate=50.0, arrival_log=log if kind == "replay" else None
    )
    out = entries.orderBy("ordinal").collect()
    times = [r.arrival_time for r in out]
    assert len(out) == 10 and times == sorted(times)
    assert metadata.first().total_tokens == sum(r.prompt_length + r.response_length for r in out)
    with pytest.raises(ValueError):
        build_trace(pairs, "id", 10, 30, 5, trace_type="other")


def test_replayed_trace_ends_with_its_log(spark, pairs):
    log = spark.range(5).select((F.col("id") * 1_000_000).alias("t_us"))
    job = lambda on_short: build_trace(
        pairs, "id", 10, 30, 5, trace_type="replay", arrival_rate=1.0, arrival_log=log, on_short=on_short
    )
    entries, metadata = job("end")
    out = entries.orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(len(out))) and 0 < len(out) < 10
    whole = job("wrap")[0].orderBy("ordinal").collect()
    assert [(r.id, r.arrival_time) for r in whole[: len(out)]] == [(r.id, r.arrival_time) for r in out]
    assert len(whole) == 10 and metadata.first().total_tokens == sum(r.prompt_length + r.response_length for r in out)
    with pytest.raises(PySparkException):
        job("raise")[0].collect()


def test_query_of_a_short_replay(spark, sf_dir, tmp_path):
    """A log of five events is shorter than the sample of all conversations: the rows are those of the SQL."""
    spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 5").write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{sf_dir}/conversations.parquet").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["trace_build_replay"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("events", "conversations"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(ORACLES["trace_build_replay"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_burst_trace(spark, pairs):
    log = spark.range(600).select(F.col("id").alias("event"), (F.col("id") * 0.5).alias("timestamp_s"))
    out = build_burst_trace(
        log, "event", pairs, "id", duration_s=15, rate=2.6, max_length=30, seed=9, strict=True
    )
    assert out.entries.count() == int(2.6 * log_span(out, log))
    assert out.metadata.first().trace_type == "burstgpt"
    assert out.rate_before.count() == 3
    assert out.tokens_after.agg(F.sum("rate")).first()[0] * 5 == out.entries.agg(F.sum("response_length")).first()[0]
    with pytest.raises(ValueError):
        build_burst_trace(log, "event", pairs, "id", duration_s=300, rate=1, max_length=30, seed=9)


def log_span(out, log):
    """The slice runs from its start to its last arrival."""
    return arrivals.time_slice(log, "timestamp_s", 15, 9).agg(F.max("timestamp_s")).first()[0]
