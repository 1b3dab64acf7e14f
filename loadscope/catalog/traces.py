"""Trace-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.catalog.inputs import sql_hash, sql_tokens, sql_uniform
from loadscope.catalog.registry import query, rounded
from loadscope.functions.randomness import choice
from loadscope.functions.text import ChatTemplate, token_count
from loadscope.operators import arrivals, ordered, traces
from loadscope.plans import trace_job

TEMPLATE = ChatTemplate()
SEED, MAX_LENGTH, RATE, REPLAY_RATE = 42, 200, 2.0, 5.0
#: Sample sizes follow the tables: a third of all conversations, a twelfth of all exchanges.
ENTRIES = "(select count(distinct conv_id) // 3 from conversations)"
CHAT_ENTRIES = "(select count(*) // 12 from chat_corpus)"
RATES = (0.5, 1.0, 2.0)


def _exchanges(i):
    return traces.first_exchange_of_turns(i.turns)


def entries_of(i) -> int:
    return i.table("conversations").select("conv_id").distinct().count() // 3


def _build(i):
    return traces.sample_entries(_exchanges(i), "conv_id", entries_of(i), MAX_LENGTH, SEED)


def _poisson(i, n, rate, seed):
    return arrivals.poisson(i.spark.range(n).withColumnRenamed("id", "ordinal"), "ordinal", rate, seed)


LENGTHS = f"select *, {sql_tokens('prompt')} as p, {sql_tokens('response')} as r from exchange"
SAMPLE = f"""
    select row_number() over (order by {sql_hash('conv_id', SEED)}, conv_id) - 1 as ordinal, *
    from ({LENGTHS}) where p + r <= {MAX_LENGTH}
    qualify row_number() over (order by {sql_hash('conv_id', SEED)}, conv_id) <= {ENTRIES}"""


def poisson_sql(ids: str, row_id: str, rate: float, seed) -> str:
    """Schedule over a table of ids: ``row_id, arrival_time``."""
    ns = f"round(-ln(1.0::double - {sql_uniform(row_id, seed)}) / {rate}::double * 1000000000.0::double)::bigint"
    return f"""
        select {row_id}, ((sum({ns}) over (order by {row_id} rows unbounded preceding) + 500) // 1000)::double
                         / 1000000.0::double as arrival_time from {ids}"""


def replay_sql(rate: float, seed) -> str:
    """Common table expressions ending in ``o``: the whole scaled schedule."""
    return f"""
        r as (select t_us - min(t_us) over () as t from arrival_log),
        s as (select count(*) as n, max(t) / 1000000.0::double as last from r),
        b as (select t // 1000000 as bucket, count(*) as n from r group by 1),
        x as (select bucket, b.n * ({rate}::double / (s.n / s.last)) as x from b, s where bucket < ceil(s.last)),
        z as (select bucket, (floor(x) + case when {sql_uniform('bucket', seed)} <= x - floor(x) then 1 else 0 end)::bigint as size from x),
        e as (select bucket, unnest(range(size)) as i from z),
        o as (select row_number() over (order by bucket, i) - 1 as ordinal, bucket::double as arrival_time from e)"""


SCHEDULE = poisson_sql(f"(select unnest(range({ENTRIES})) as ordinal)", "ordinal", RATE, SEED)


@query("trace_first_exchange", "select conv_id, prompt, response from exchange")
def trace_first_exchange(i):
    return _exchanges(i)


@query(
    "trace_corpus_filter",
    "select id, prompt, response from chat_corpus where model = 'gpt-4' and turn = 1 and language = 'English'",
)
def trace_corpus_filter(i):
    return traces.filter_corpus(i.chat_corpus)


@query(
    "trace_corpus_violations",
    """
    select conv_id, turns from (
        select conv_id, count(*) as turns, min(role) filter (turn = 0) as opening, min(role) filter (turn = 1) as reply
        from conversations group by 1)
    where conv_id % 3 <> 0 and conv_id % 4 <> 3
      and not (turns = 2 and opening is not distinct from 'user' and reply is not distinct from 'assistant')""",
)
def trace_corpus_violations(i):
    # Two messages are one exchange; of any other conversation the number of turns says enough.
    conv = F.col("conv_id")
    head = i.table("conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        *[
            F.max(F.when(F.col("turn") == t, F.struct("role", F.col("text").alias("content")))).alias(f"m{t}")
            for t in range(2)
        ],
    )
    corpus = head.select(
        "conv_id",
        "turns",
        F.when(conv % 3 == 0, "gpt-3.5").otherwise("gpt-4").alias("model"),
        F.lit(1).alias("turn"),
        F.when(conv % 4 == 3, "French").otherwise("English").alias("language"),
        F.when(F.col("turns") == 2, F.array("m0", "m1")).otherwise(F.array("m0")).alias("conversation"),
    )
    return traces.corpus_violations(corpus).select("conv_id", "turns")


@query(
    "text_token_count",
    f"select conv_id, turn, {sql_tokens('text')}::int as tokens, ({sql_tokens('text')} + 1)::int as with_specials from conversations",
)
def text_token_count(i):
    text = F.col("text")
    return i.table("conversations").select(
        "conv_id", "turn", token_count(text).alias("tokens"), token_count(text, specials=1).alias("with_specials")
    )


@query(
    "text_chat_template",
    """
    select id,
           '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt_text,
           '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10)
             || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10) as exchange_text
    from chat_corpus""",
)
def text_chat_template(i):
    talk = F.col("conversation")
    prompt, response = talk[0]["content"], talk[1]["content"]
    return i.chat_corpus.select(
        "id", TEMPLATE.user_prompt(prompt).alias("prompt_text"), TEMPLATE.exchange(prompt, response).alias("exchange_text")
    )


@query(
    "trace_no_prompt",
    f"select conv_id, '' as prompt, 0 as prompt_length, {sql_tokens('response')}::int as response_length from exchange",
)
def trace_no_prompt(i):
    pairs = traces.prepare_prompts(_exchanges(i), template=TEMPLATE, no_prompt=True)
    return traces.with_lengths(pairs).select("conv_id", "prompt", "prompt_length", "response_length")


@query(
    "sample_shuffle_rank",
    f"select doc_id, row_number() over (order by {sql_hash('doc_id', 7)}, doc_id) - 1 as position from documents",
)
def sample_shuffle_rank(i):
    return ordered.hash_rank(i.table("documents").select("doc_id"), F.col("doc_id"), 7, "position")


@query(
    "sample_variant_assign",
    f"""
    select request_guid, ['variant_a', 'variant_b', 'variant_c'][1 + floor({sql_uniform('request_guid', SEED)} * 3)::int] as variant
    from (select distinct request_guid from request_log where is_warmup_request = 0)""",
)
def sample_variant_assign(i):
    requests = i.request_log.where("is_warmup_request = 0").select("request_guid").distinct()
    pick = choice(["variant_a", "variant_b", "variant_c"], F.col("request_guid"), SEED)
    return requests.withColumn("variant", pick)


@query(
    "trace_build",
    f"""
    select s.ordinal, s.conv_id, s.prompt, s.response, s.p::int as prompt_length, s.r::int as response_length, a.arrival_time
    from ({SAMPLE}) s join ({SCHEDULE}) a on a.ordinal = s.ordinal""",
)
def trace_build(i):
    return traces.with_arrivals(_build(i), _poisson(i, entries_of(i), RATE, SEED))


@query(
    "trace_build_capped",
    f"""
    with c as (select id, prompt, response,
                      row_number() over (order by {sql_hash('id', SEED)}, id) as try
               from chat_corpus where model = 'gpt-4' and turn = 1 and language = 'English'),
    f as (select *, {sql_tokens('prompt')} as p, {sql_tokens('response')} as r from c where try <= 3 * {CHAT_ENTRIES})
    select row_number() over (order by try) - 1 as ordinal, id, p::int as prompt_length, r::int as response_length,
           0.0::double as arrival_time
    from f where p + r <= {MAX_LENGTH} qualify row_number() over (order by try) <= {CHAT_ENTRIES}""",
)
def trace_build_capped(i):
    pairs = traces.filter_corpus(i.chat_corpus)
    n = i.chat_corpus.count() // 12
    entries = traces.sample_entries(pairs, "id", n, MAX_LENGTH, SEED, candidates=traces.CANDIDATES_PER_ENTRY * n)
    return traces.with_arrivals(entries, None).drop("prompt", "response")


@query(
    "trace_build_grid",
    " union all ".join(
        f"""select {rate}::double as arrival_rate, s.ordinal, s.conv_id, s.p::int as prompt_length,
                   s.r::int as response_length, a.arrival_time
            from ({SAMPLE}) s join ({poisson_sql(f'(select unnest(range({ENTRIES})) as ordinal)', 'ordinal', rate, SEED)}) a
              on a.ordinal = s.ordinal"""
        for rate in RATES
    ),
)
def trace_build_grid(i):
    schedules = None
    for rate in RATES:
        one = _poisson(i, entries_of(i), rate, SEED).withColumn("arrival_rate", F.lit(rate))
        schedules = one if schedules is None else schedules.unionByName(one)
    entries = _build(i).drop("prompt", "response")
    return traces.with_arrivals_by(entries, schedules, ["arrival_rate"])


@query(
    "trace_metadata",
    f"""
    select 0 as num_warmup_requests, count(*)::double as avg_entries_per_partition,
           max(p)::int as max_prompt_length, min(p)::int as min_prompt_length, round(avg(p), 6) as avg_prompt_length,
           max(r)::int as max_response_length, min(r)::int as min_response_length, round(avg(r), 6) as avg_response_length,
           round(avg(p + r), 6) as avg_total_length, max(p + r)::int as max_total_length,
           sum(p + r)::bigint as total_tokens, 'poisson' as trace_type, 2.0::double as arrival_rate
    from ({SAMPLE})""",
)
def trace_metadata(i):
    return rounded(traces.metadata(_build(i), "poisson", RATE), 6)


@query(
    "trace_count_above",
    f"select count(*) filter (p + r > 100) as num_above from ({LENGTHS})",
)
def trace_count_above(i):
    return traces.count_above(traces.with_lengths(_exchanges(i)), 100)


@query(
    "trace_with_warmup",
    f"""
    select ordinal, p::int as prompt_length, r::int as response_length, 0.0::double as arrival_time from ({SAMPLE})
    union all
    select unnest([-3, -2, -1]), 6, 7, 0.0::double""",
)
def trace_with_warmup(i):
    cols = ["ordinal", "prompt_length", "response_length", "arrival_time"]
    entries = traces.with_arrivals(_build(i), None).select(*cols)
    return entries.unionByName(traces.warmup_entries(i.spark, 3).select(*cols))


@query(
    "trace_build_replay",
    f"""
    with {replay_sql(REPLAY_RATE, SEED)}
    select s.ordinal, s.conv_id, s.p::int as prompt_length, s.r::int as response_length, o.arrival_time
    from ({SAMPLE}) s join o on o.ordinal = s.ordinal""",
)
def trace_build_replay(i):
    entries, _ = trace_job.build_trace(
        _exchanges(i), "conv_id", entries_of(i), MAX_LENGTH, SEED,
        trace_type="replay", arrival_rate=REPLAY_RATE, arrival_log=i.arrival_log, on_short="end",
    )
    return entries.drop("prompt", "response")
