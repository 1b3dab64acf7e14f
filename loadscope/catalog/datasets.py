"""Fine-tuning data set queries."""

from __future__ import annotations

from loadscope.catalog.inputs import sql_hash, sql_tokens
from loadscope.catalog.registry import query, rounded
from loadscope.functions.text import ChatTemplate
from loadscope.operators import datasets

TEMPLATE = ChatTemplate()
SEED, TEXT_CAP, TALK_CAP = 42, 512, 400
#: Sample sizes follow the tables.
QA_ENTRIES = "(select count(*) // 6 from qa_corpus)"
FIRST_ENTRIES = "(select count(distinct conv_id) // 4 from conversations)"

_DOCS = f"select doc_id, text, {sql_tokens('text')} as c from documents"
_QA = "select * from qa_corpus where (contains(category, 'open_qa') or contains(category, 'closed_qa')) and length(context) = 0"
_TALKS = f"""
    select conv_id,
           (case when bool_or(turn = 0 and "from" = 'system') then '' else '<|im_start|>system' || chr(10) || '<|im_end|>' || chr(10) end)
             || string_agg('<|im_start|>' || "from" || chr(10) || value || '<|im_end|>' || chr(10), '' order by turn) as text
    from turns group by conv_id"""
_TALK_COUNTS = f"select conv_id, text, {sql_tokens('text')} + 1 as c from ({_TALKS})"


def _counted(i):
    return datasets.with_token_count(i.documents)


def _talk_lengths(i):
    return datasets.conversation_lengths(i.turns, TEMPLATE, specials=1)


@query("ds_qa_filter", f"select id, category, instruction, response from ({_QA})")
def ds_qa_filter(i):
    return datasets.qa_only(i.qa_corpus).drop("context")


@query(
    "ds_qa_sample",
    f"""
    select row_number() over (order by {sql_hash('id', SEED)}, id) - 1 as ordinal, id,
           '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10)
             || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10) as text
    from ({_QA}) qualify row_number() over (order by {sql_hash('id', SEED)}, id) <= {QA_ENTRIES}""",
)
def ds_qa_sample(i):
    rows = datasets.first_n(datasets.qa_only(i.qa_corpus), "id", i.qa_corpus.count() // 6, seed=SEED)
    return datasets.templated_exchanges(rows, TEMPLATE).select("ordinal", "id", "text")


@query("ds_length_cap", f"select doc_id, text, c::int as token_count from ({_DOCS}) where c < {TEXT_CAP}")
def ds_length_cap(i):
    return datasets.length_cap(_counted(i), TEXT_CAP)


@query(
    "ds_first_n",
    f"""
    select row_number() over (order by conv_id) - 1 as ordinal, conv_id, c::bigint as token_count
    from ({_TALK_COUNTS}) where c < {TALK_CAP}
    qualify row_number() over (order by conv_id) <= {FIRST_ENTRIES}""",
)
def ds_first_n(i):
    capped = datasets.length_cap(_talk_lengths(i), TALK_CAP)
    n = i.table("conversations").select("conv_id").distinct().count() // 4
    return datasets.first_n(capped, "conv_id", n, strict=True)


@query("ds_conversation_text", f"select conv_id, text, c::bigint as token_count from ({_TALK_COUNTS}) where c < {TALK_CAP}")
def ds_conversation_text(i):
    capped = datasets.length_cap(_talk_lengths(i), TALK_CAP)
    return datasets.render_conversations(i.turns, capped, TEMPLATE)


@query("ds_instruct_projection", f"select doc_id, lang, source, n_chars from documents where {sql_tokens('text')} < {TEXT_CAP}")
def ds_instruct_projection(i):
    counted = datasets.with_token_count(i.table("documents"))
    return datasets.instruct_projection(datasets.length_cap(counted, TEXT_CAP))


@query(
    "ds_length_stats",
    f"select count(c) as entries, max(c)::int as max_length, min(c)::int as min_length, round(avg(c), 6) as avg_length from ({_DOCS})",
)
def ds_length_stats(i):
    return rounded(datasets.length_stats(_counted(i)), 6)


def _shares_sql(stage: str, where: str) -> str:
    return f"""
        select '{stage}' as stage, t.threshold::int as threshold, count(*) filter (c < t.threshold) as below,
               round(count(*) filter (c < t.threshold) / count(*)::double * 100, 6) as percentage
        from ({_DOCS}) cross join (select unnest({list(datasets.THRESHOLDS)}) as threshold) t
        where {where} group by t.threshold"""


@query("ds_threshold_cdf", f"{_shares_sql('original', 'true')} union all {_shares_sql('filtered', 'c < 2048')}")
def ds_threshold_cdf(i):
    return rounded(datasets.threshold_shares(_counted(i), cap=2048), 6)


@query(
    "ds_token_histogram",
    f"""
    with d as ({_DOCS}), b as (select min(c)::double as lo, max(c)::double as hi from d),
    n as (select least(floor((c - lo) / ((hi - lo) / 50)), 49)::bigint as bin, count(*) as n from d, b group by 1)
    select g.bin, round(lo + g.bin * ((hi - lo) / 50), 6) as bin_low, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) as bin_high,
           coalesce(n.n, 0) as entries, {TEXT_CAP} as cutoff
    from (select unnest(range(50)) as bin) g cross join b left join n on n.bin = g.bin""",
)
def ds_token_histogram(i):
    return rounded(datasets.histogram(_counted(i), cutoff=TEXT_CAP), 6)


@query(
    "ds_fixed_length",
    "select doc_id, repeat('token ', 1022) || 'token' as text, 1023 as token_count from documents",
)
def ds_fixed_length(i):
    return datasets.fixed_length_texts(i.table("documents").select("doc_id"), 1023)
