"""Request traces: corpus to exchanges, sampled, token-counted and time-stamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.functions.text import ChatTemplate, token_count
from loadscope.operators import ordered
from loadscope.operators.checks import require, require_rows

# The warm-up exchange, the long-entry mark, the placeholder text,
# the corpus filter and the candidate factor.
WARMUP_PROMPT = "Hello, how are you?"
WARMUP_RESPONSE = "I'm doing well, thank you for asking."
LONG_ENTRY_TOKENS = 2048
PLACEHOLDER = "empty"
CORPUS_MODEL, CORPUS_TURN, CORPUS_LANGUAGE = "gpt-4", 1, "English"
CANDIDATES_PER_ENTRY = 3


# -- corpus to exchanges --------------------------------------------------------


def first_exchange(corpus: DataFrame) -> DataFrame:
    """Prompt and response of nested conversations that open with human, then gpt."""
    turns = F.col("conversations")
    opening, reply = F.get(turns, F.lit(0)), F.get(turns, F.lit(1))
    kept = corpus.where((F.size(turns) >= 2) & (opening["from"] == "human") & (reply["from"] == "gpt"))
    others = [c for c in corpus.columns if c != "conversations"]
    return kept.select(*others, opening["value"].alias("prompt"), reply["value"].alias("response"))


def first_exchange_of_turns(turns: DataFrame) -> DataFrame:
    """The same from one row per turn (``conv_id, turn, from, value``, turns from 0).

    Only the first two turns leave the scan, so a group has at most two rows
    however long a conversation is, and the text is read once.
    """

    def said(turn: int, speaker: str) -> Column:
        is_it = (F.col("turn") == turn) & (F.col("from") == speaker)
        return F.max(F.when(is_it, F.col("value")))

    opening = turns.where(F.col("turn").isin(0, 1)).groupBy("conv_id")
    both = opening.agg(said(0, "human").alias("prompt"), said(1, "gpt").alias("response"))
    return both.where(F.col("prompt").isNotNull() & F.col("response").isNotNull())


def _two_messages() -> Column:
    talk = F.col("conversation")
    return (
        (F.size(talk) == 2)
        & F.get(talk, F.lit(0))["role"].eqNullSafe("user")
        & F.get(talk, F.lit(1))["role"].eqNullSafe("assistant")
    )


def _of_interest(corpus: DataFrame) -> DataFrame:
    return corpus.where(
        (F.col("model") == CORPUS_MODEL)
        & (F.col("turn") == CORPUS_TURN)
        & (F.col("language") == CORPUS_LANGUAGE)
    )


def filter_corpus(corpus: DataFrame, *, strict: bool = True) -> DataFrame:
    """Single-turn English exchanges of one model as prompt and response.

    A row that is not exactly user, assistant raises; without ``strict`` it is
    left out here and returned by :func:`corpus_violations`.
    """
    rows = _of_interest(corpus)
    talk = F.col("conversation")
    prompt = F.get(talk, F.lit(0))["content"]
    if strict:
        rows = require_rows(rows, _two_messages(), "expected one user and one assistant message")
    else:
        rows = rows.where(_two_messages())
    others = [c for c in corpus.columns if c not in ("conversation", "model", "turn", "language")]
    return rows.select(*others, prompt.alias("prompt"), F.get(talk, F.lit(1))["content"].alias("response"))


def corpus_violations(corpus: DataFrame) -> DataFrame:
    return _of_interest(corpus).where(~_two_messages())


# -- lengths --------------------------------------------------------------------


def prepare_prompts(
    pairs: DataFrame, *, template: ChatTemplate | None = None, no_prompt: bool = False
) -> DataFrame:
    """Template the prompt, then blank it when asked: blanking always wins."""
    prompt = template.user_prompt(F.col("prompt")) if template else F.col("prompt")
    return pairs.withColumn("prompt", F.lit("") if no_prompt else prompt)


def with_lengths(pairs: DataFrame, count_tokens=token_count) -> DataFrame:
    return pairs.withColumns(
        {
            "prompt_length": count_tokens(F.col("prompt")),
            "response_length": count_tokens(F.col("response")),
        }
    )


def fits(max_length: int) -> Column:
    """The cap of a trace entry is inclusive."""
    return F.col("prompt_length") + F.col("response_length") <= max_length


# -- sampling and time stamps ---------------------------------------------------


def sample_entries(
    pairs: DataFrame, row_id: str, n: int, max_length: int, seed: int, *,
    candidates: int | None = None, count_tokens=token_count,
) -> DataFrame:
    """The first ``n`` pairs of a seeded shuffle that fit, numbered from 0 as ``ordinal``.

    With ``candidates`` only that many shuffled pairs are tried, and a corpus that
    has fewer raises.
    """
    key = F.col(row_id)

    def fitting(rows: DataFrame) -> DataFrame:
        return with_lengths(rows, count_tokens).where(fits(max_length))

    if candidates is None:
        return ordered.hash_rank(pairs, key, seed, "ordinal", upto=n, keep=fitting)
    tried = ordered.hash_rank(pairs, key, seed, "_try", upto=candidates)
    found = pairs.agg(F.count(F.lit(1)).alias("c")).scalar()
    sample = ordered.hash_rank(tried.drop("_try"), key, seed, "ordinal", upto=n, keep=fitting)
    return require(sample, found >= candidates, f"the corpus has fewer than {candidates} candidates")


def with_arrivals(entries: DataFrame, schedule: DataFrame | None, *, ends: bool = False) -> DataFrame:
    """The k-th entry gets the k-th arrival; without a schedule every arrival is 0.

    A schedule shorter than the trace raises, or with ``ends`` the trace ends with it.
    """
    if schedule is None:
        return entries.withColumn("arrival_time", F.lit(0.0))
    times = schedule.select("ordinal", "arrival_time")
    if ends:
        return entries.join(times, "ordinal")
    return _all_timed(entries.join(times, "ordinal", "left"))


def _all_timed(entries: DataFrame) -> DataFrame:
    return require_rows(entries, F.col("arrival_time").isNotNull(), "the arrival schedule is shorter than the trace")


def with_arrivals_by(entries: DataFrame, schedules: DataFrame, keys: list[str]) -> DataFrame:
    """One copy of the entries per key of ``schedules``: a trace for every cell of a grid."""
    times = schedules.select(*keys, "ordinal", "arrival_time")
    return entries.join(times, "ordinal")


def warmup_entries(spark: SparkSession, n: int, template: ChatTemplate | None = None) -> DataFrame:
    """``n`` constant entries at time 0, numbered before every other entry."""
    template = template or ChatTemplate()
    rows = spark.range(n).select(
        (F.col("id") - n).alias("ordinal"),
        template.user_prompt(F.lit(WARMUP_PROMPT)).alias("prompt"),
        F.lit(WARMUP_RESPONSE).alias("response"),
    )
    return with_lengths(rows).withColumn("arrival_time", F.lit(0.0))


def attach_pairs(
    rows: DataFrame, pairs: DataFrame, pair_id: str, max_length: int, seed: int, *,
    order: list[str], count_tokens=token_count, strict: bool = True,
) -> DataFrame:
    """Give the i-th row the i-th shuffled pair; a pair that is too long leaves a gap.

    Rows are numbered in ``order``. A row without a pair keeps the placeholder
    texts and zero lengths; with ``strict`` more rows than pairs raise.
    """
    runs = ordered.sorted_runs(rows, order)
    needed = runs.agg(F.count(F.lit(1)).alias("c")).scalar()
    numbered = ordered.run_row_number(runs, order, "ordinal").drop("_run")
    numbered = numbered.withColumn("ordinal", F.col("ordinal") - 1)
    ranked = ordered.hash_rank(pairs, F.col(pair_id), seed, "_rank", upto=needed)
    ranked = with_lengths(ranked, count_tokens).withColumn("_fits", fits(max_length))
    texts = ["prompt", "response", "prompt_length", "response_length"]
    # Texts that are too long are dropped before they are shuffled.
    usable = ranked.select("_rank", *[F.when(F.col("_fits"), F.col(c)).alias(c) for c in texts])
    joined = numbered.join(usable, numbered["ordinal"] == usable["_rank"], "left")
    if strict:
        joined = require_rows(joined, F.col("_rank").isNotNull(), "more rows than pairs")
    return joined.drop("_rank").withColumns(
        {
            "prompt": F.coalesce("prompt", F.lit(PLACEHOLDER)),
            "response": F.coalesce("response", F.lit(PLACEHOLDER)),
            "prompt_length": F.coalesce("prompt_length", F.lit(0)),
            "response_length": F.coalesce("response_length", F.lit(0)),
        }
    )


# -- metadata -------------------------------------------------------------------


def metadata(entries: DataFrame, trace_type: str = "offline", arrival_rate: float = 0.0) -> DataFrame:
    """One row describing a trace."""
    p, r = F.col("prompt_length"), F.col("response_length")
    return entries.agg(
        F.lit(0).alias("num_warmup_requests"),
        F.count(F.lit(1)).cast("double").alias("avg_entries_per_partition"),
        F.max(p).alias("max_prompt_length"),
        F.min(p).alias("min_prompt_length"),
        F.avg(p).alias("avg_prompt_length"),
        F.max(r).alias("max_response_length"),
        F.min(r).alias("min_response_length"),
        F.avg(r).alias("avg_response_length"),
        F.avg(p + r).alias("avg_total_length"),
        F.max(p + r).alias("max_total_length"),
        F.sum(p + r).alias("total_tokens"),
        F.lit(trace_type).alias("trace_type"),
        F.lit(float(arrival_rate)).alias("arrival_rate"),
    )


def count_above(entries: DataFrame, tokens: int = LONG_ENTRY_TOKENS) -> DataFrame:
    total = F.col("prompt_length") + F.col("response_length")
    return entries.agg(F.count_if(total > tokens).alias("num_above"))
