"""Arrival-schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.catalog.inputs import sql_hash, sql_tokens, sql_uniform
from loadscope.catalog.registry import query, rounded
from loadscope.catalog.traces import LENGTHS, REPLAY_RATE, poisson_sql, replay_sql
from loadscope.operators import arrivals, traces
from loadscope.session import write_table

SEED, RATE, SLICE_S = 42, 2.0, 600
#: Nine tenths of what the scaled log holds, and twice as many arrivals as events.
REPLAY_N = f"(select floor((max(t_us) - min(t_us)) * {REPLAY_RATE} * 9 / 10000000)::bigint from arrival_log)"
WRAP_N = "(select count(*) * 2 from events)"
DOWN_RATE, UP_RATE, ATTACH_RATE, MAX_LENGTH = 0.5, 50.0, 0.1, 200


def _events(i):
    return i.table("events").select("event_id")


def _chat(i):
    return i.burst_log.where("model = 'ChatGPT'").drop("model")


def _slice(i):
    return arrivals.time_slice(_chat(i), "timestamp_s", SLICE_S, SEED)


@query("arrival_log_rebased", "select event_id, t_us - min(t_us) over () as t_us from arrival_log")
def arrival_log_rebased(i):
    return arrivals.rebase(i.arrival_log, "t_us")


@query("burst_log_filtered", "select event_id, timestamp_s from burst_log where model = 'ChatGPT'")
def burst_log_filtered(i):
    return _chat(i)


_POISSON = poisson_sql("events", "event_id", RATE, SEED)


@query("arrival_poisson", _POISSON)
def arrival_poisson(i):
    return arrivals.poisson(_events(i), "event_id", RATE, SEED)


@query("arrival_mean_gap", f"select round((max(arrival_time) - min(arrival_time)) / (count(*) - 1), 9) as mean_gap from ({_POISSON})")
def arrival_mean_gap(i):
    return rounded(arrivals.mean_gap(arrivals.poisson(_events(i), "event_id", RATE, SEED)), 9)


_NS = f"round(-ln(1.0::double - {sql_uniform('event_id', SEED)}) / {RATE}::double * 1000000000.0::double)::bigint"


@query(
    "arrival_gamma_b1",
    f"""
    select event_id, ((sum(ns) over (order by event_id rows unbounded preceding) - ns + 500) // 1000)::double / 1000000.0::double as arrival_time
    from (select event_id, {_NS} as ns from events)""",
)
def arrival_gamma_b1(i):
    return arrivals.bursty(_events(i), "event_id", RATE, SEED, 1.0)


_HALF = (
    f"round(-ln(1.0::double - {sql_uniform('event_id', f'{SEED}ga')}) * cos(2 * pi() * {sql_uniform('event_id', f'{SEED}gb')})"
    f" * cos(2 * pi() * {sql_uniform('event_id', f'{SEED}gb')}) * (1000000000.0::double / ({RATE}::double * 0.5::double)))::bigint"
)


@query(
    "arrival_gamma",
    f"""
    select event_id, ((sum(ns) over (order by event_id rows unbounded preceding) - ns + 500) // 1000)::double / 1000000.0::double as arrival_time
    from (select event_id, {_HALF} as ns from events)""",
)
def arrival_gamma(i):
    return arrivals.bursty(_events(i), "event_id", RATE, SEED, 0.5)


@query("arrival_replay", f"with {replay_sql(REPLAY_RATE, SEED)} select ordinal, arrival_time from o where ordinal < {REPLAY_N}")
def arrival_replay(i):
    low, high = i.arrival_log.agg(F.min("t_us"), F.max("t_us")).first()
    return arrivals.replay(i.arrival_log, "t_us", REPLAY_RATE, int((high - low) * REPLAY_RATE * 9 // 10_000_000), SEED)


@query(
    "arrival_replay_wrap",
    f"""
    with {replay_sql(REPLAY_RATE, SEED)}, t as (select count(*) as n, max(arrival_time) as last from o),
    l as (select unnest(range(ceil({WRAP_N} / (select n from t)::double)::bigint)) as lap)
    select o.ordinal + l.lap * t.n as ordinal, o.arrival_time + l.lap * t.last as arrival_time
    from o, l, t where o.ordinal + l.lap * t.n < {WRAP_N}""",
)
def arrival_replay_wrap(i):
    return arrivals.replay(i.arrival_log, "t_us", REPLAY_RATE, i.table("events").count() * 2, SEED, on_short="wrap")


_SLICE = f"""
    bounds as (select min(timestamp_s) as lo, max(timestamp_s) - {SLICE_S}.0::double - min(timestamp_s) as room
               from burst_log where model = 'ChatGPT'),
    start as (select lo + {sql_uniform("'slice'", SEED)} * room as s from bounds),
    slice as (select event_id, timestamp_s - s as timestamp_s from burst_log, start
              where model = 'ChatGPT' and timestamp_s >= s and timestamp_s < s + {SLICE_S})"""


@query("arrival_time_slice", f"with {_SLICE} select event_id, round(timestamp_s, 6) as timestamp_s from slice")
def arrival_time_slice(i):
    return rounded(_slice(i), 6)


def _down_sql(rate: float) -> str:
    return f"""
        {_SLICE}, target as (select floor({rate}::double * max(timestamp_s))::bigint as n from slice),
        kept as (select * from (select event_id, timestamp_s, row_number() over (order by {sql_hash('event_id', SEED)}, event_id) as rk from slice)
                 where rk <= (select n from target)),
        scaled as (select event_id, timestamp_s - min(timestamp_s) over () as timestamp_s from kept)"""


@query("arrival_downsample", f"with {_down_sql(DOWN_RATE)} select event_id, 0 as copy, round(timestamp_s, 6) as timestamp_s from scaled")
def arrival_downsample(i):
    return rounded(arrivals.scale_rate(_slice(i), "event_id", "timestamp_s", DOWN_RATE, SEED), 6)


_TWIN = "(event_id || '-' || copy)"
_UP = f"""
    {_SLICE}, size as (select count(*) as have, floor({UP_RATE}::double * max(timestamp_s))::bigint as n from slice),
    gap as (select min(d) as gap from (select timestamp_s - lag(timestamp_s) over (order by timestamp_s, event_id) as d from slice)),
    copies as (select event_id, timestamp_s, unnest(range(ceil((select n / have::double from size))::bigint)) as copy from slice),
    jittered as (select event_id, copy,
                        timestamp_s + case when copy > 0 then {sql_uniform(_TWIN, f'jitter{SEED}')} * (select gap from gap) / 10 else 0 end as timestamp_s
                 from copies),
    kept as (select * from (select *, row_number() over (order by {sql_hash(_TWIN, SEED)}, {_TWIN}) as rk from jittered)
             where rk <= (select n from size)),
    scaled as (select event_id, copy, timestamp_s - min(timestamp_s) over () as timestamp_s from kept)"""


@query("arrival_upsample", f"with {_UP} select event_id, copy::int as copy, round(timestamp_s, 9) as timestamp_s from scaled")
def arrival_upsample(i):
    return rounded(arrivals.scale_rate(_slice(i), "event_id", "timestamp_s", UP_RATE, SEED), 9)


@query(
    "arrival_scale_rate",
    f"with {_UP} select count(*) as requests, round(max(timestamp_s), 6) as duration_s, round(count(*) / max(timestamp_s), 6) as rate from scaled",
)
def arrival_scale_rate(i):
    scaled = arrivals.scale_rate(_slice(i), "event_id", "timestamp_s", UP_RATE, SEED)
    return rounded(arrivals.rate_report(scaled, "timestamp_s"), 6)


_HALF_LOG = """
    log as (select event_id, timestamp_s - min(timestamp_s) over () as timestamp_s from burst_log where model = 'ChatGPT'),
    target as (select floor(count(*) / max(timestamp_s) / 2 * max(timestamp_s))::bigint as n from log),"""


@query(
    "arrival_halved_log",
    f"""
    with {_HALF_LOG}
    kept as (select * from (select event_id, timestamp_s, row_number() over (order by {sql_hash('event_id', SEED)}, event_id) as rk from log)
             where rk <= (select n from target))
    select event_id, 0 as copy, round(timestamp_s - min(timestamp_s) over (), 6) as timestamp_s from kept""",
)
def arrival_halved_log(i):
    """The whole log at half its own rate."""
    log = arrivals.rebase(_chat(i), "timestamp_s")
    own = arrivals.rate_report(log, "timestamp_s").first()
    return rounded(arrivals.scale_rate(log, "event_id", "timestamp_s", own["rate"] / 2, SEED), 6)


@query(
    "arrival_min_gap",
    """
    select round(min(d), 6) as min_gap from (
        select timestamp_s - lag(timestamp_s) over (order by timestamp_s, event_id) as d
        from burst_log where model = 'ChatGPT')""",
)
def arrival_min_gap(i):
    return rounded(arrivals.min_gap(_chat(i), "timestamp_s"), 6)


@query(
    "trace_attach_prompts",
    f"""
    with {_down_sql(ATTACH_RATE)},
    a as (select *, row_number() over (order by timestamp_s, event_id) - 1 as ordinal from scaled),
    p as (select *, row_number() over (order by {sql_hash('conv_id', SEED)}, conv_id) - 1 as ordinal from ({LENGTHS})),
    u as (select * from p where p + r <= {MAX_LENGTH})
    select a.ordinal, a.event_id, round(a.timestamp_s, 3) as arrival_time, coalesce(u.prompt, 'empty') as prompt,
           coalesce(u.response, 'empty') as response, coalesce(u.p, 0)::int as prompt_length, coalesce(u.r, 0)::int as response_length
    from a left join u on u.ordinal = a.ordinal""",
)
def trace_attach_prompts(i):
    # numbering reads its rows several times
    scaled = write_table(arrivals.scale_rate(_slice(i), "event_id", "timestamp_s", ATTACH_RATE, SEED), "scaled")
    pairs = traces.first_exchange_of_turns(i.turns)
    attached = traces.attach_pairs(
        scaled, pairs, "conv_id", MAX_LENGTH, SEED, order=["timestamp_s", "event_id"]
    )
    return attached.select(
        "ordinal", "event_id", F.round("timestamp_s", 3).alias("arrival_time"),
        "prompt", "response", "prompt_length", "response_length",
    )


def _histogram_sql(amount: str, source: str) -> str:
    return f"""
    with l as ({source}), n as (select greatest(ceil(max(t) / 5), 1)::bigint as bins from l),
    c as (select least(floor(t / 5)::bigint, bins - 1) as bin, {amount} as amount from l, n group by 1)
    select g.bin, (g.bin * 5 + 2.5)::double as center, round(coalesce(c.amount, 0) / 5.0::double, 6) as rate
    from (select unnest(range((select bins from n))) as bin) g left join c on c.bin = g.bin"""


@query(
    "arrival_rate_histogram",
    _histogram_sql("count(*)", "select timestamp_s as t from burst_log where model = 'ChatGPT'"),
)
def arrival_rate_histogram(i):
    return rounded(arrivals.rate_histogram(_chat(i), "timestamp_s"), 6, "rate")


@query(
    "arrival_token_histogram",
    _histogram_sql(
        "sum(w)",
        f"""select timestamp_s as t, {sql_tokens('c.text')} as w from burst_log b
            join conversations c on c.turn = 1 and c.conv_id = b.event_id % (select count(distinct conv_id) from conversations)
            where model = 'ChatGPT'""",
    ),
)
def arrival_token_histogram(i):
    talks = i.table("conversations")
    count = talks.agg(F.count_distinct("conv_id").alias("n")).scalar()
    replies = talks.where("turn = 1").select("conv_id", F.col("text").alias("response"))
    lengths = replies.select("conv_id", traces.token_count(F.col("response")).alias("response_length"))
    log = _chat(i).withColumn("n", count).withColumn("conv_id", F.col("event_id") % F.col("n"))
    return rounded(
        arrivals.rate_histogram(log.join(lengths, "conv_id"), "timestamp_s", weight="response_length"), 6, "rate"
    )


@query(
    "arrival_rate_report",
    f"with {_SLICE} select count(*) as requests, round(max(timestamp_s), 6) as duration_s, round(count(*) / max(timestamp_s), 6) as rate from slice",
)
def arrival_rate_report(i):
    return rounded(arrivals.rate_report(_slice(i), "timestamp_s"), 6)
