"""Fine-tuning data sets: filtering, templating, length caps and length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import ChatTemplate, token_count
from loadscope.operators import ordered
from loadscope.operators.checks import require, require_rows

# The reported thresholds, histogram bins and the QA categories.
THRESHOLDS = (1024, 2048, 4096, 8000, 8192, 16384)
HISTOGRAM_BINS = 50
QA_CATEGORIES = ("open_qa", "closed_qa")


def with_token_count(texts: DataFrame, count_tokens=token_count) -> DataFrame:
    return texts.withColumn("token_count", count_tokens(F.col("text")))


def length_cap(texts: DataFrame, max_length: int) -> DataFrame:
    """The cap of a data set is strict."""
    return texts.where(F.col("token_count") < max_length)


def qa_only(rows: DataFrame) -> DataFrame:
    """Question-answering rows without a context."""
    category = F.col("category")
    wanted = category.contains(QA_CATEGORIES[0]) | category.contains(QA_CATEGORIES[1])
    return rows.where(wanted & (F.length("context") == 0))


def templated_exchanges(rows: DataFrame, template: ChatTemplate) -> DataFrame:
    return rows.withColumn("text", template.exchange(F.col("instruction"), F.col("response")))


def first_n(rows: DataFrame, row_id: str, n: int, *, seed: int | None = None, strict: bool = False) -> DataFrame:
    """The first ``n`` rows in shuffled order, or in id order without a seed.

    ``strict`` raises when there are fewer than ``n``.
    """
    if seed is not None:
        out = ordered.hash_rank(rows, F.col(row_id), seed, "ordinal", upto=n)
    else:
        out = ordered.first_by_id(rows, row_id, n, "ordinal")
    if strict:
        found = rows.agg(F.count(F.lit(1)).alias("c")).scalar()
        out = require(out, found >= n, f"fewer than {n} rows")
    return out


# -- whole conversations --------------------------------------------------------


def conversation_lengths(turns: DataFrame, template: ChatTemplate, specials: int = 0) -> DataFrame:
    """Token count of every templated conversation, system message first, without building it.

    Counts of the templated turns add up (the template ends a message with a
    blank), so a conversation of any length is one partial sum per task. The
    system message is always there, empty when the conversation has none.
    """
    if not template.counts_add_up:
        raise ValueError("the template must end a message with a blank for counts to add up")
    is_system = (F.col("turn") == 0) & (F.col("from") == "system")
    counts = turns.withColumn("_tokens", token_count(template.message(F.col("from"), F.col("value"))))
    empty_system = token_count(template.message(F.lit("system"), F.lit("")))
    total = F.sum("_tokens") + F.when(F.max(is_system.cast("int")) == 1, 0).otherwise(empty_system)
    return counts.groupBy("conv_id").agg((total + specials).cast("bigint").alias("token_count"))


def render_conversations(turns: DataFrame, kept: DataFrame, template: ChatTemplate) -> DataFrame:
    """Texts of the conversations in ``kept``, which a length cap has bounded.

    Only capped conversations are assembled, so a row holds at most the cap's
    worth of tokens however long the longest conversation of the corpus is.
    """
    is_system = (F.col("turn") == 0) & (F.col("from") == "system")
    part = F.struct("turn", template.message(F.col("from"), F.col("value")).alias("part"))
    texts = (
        turns.join(kept.select("conv_id", "token_count"), "conv_id")
        .groupBy("conv_id", "token_count")
        .agg(
            F.array_sort(F.collect_list(part)).alias("_parts"),
            F.max(is_system.cast("int")).alias("_has_system"),
        )
    )
    body = F.array_join(F.transform("_parts", lambda p: p["part"]), "")
    lead = F.when(F.col("_has_system") == 1, F.lit("")).otherwise(
        template.message(F.lit("system"), F.lit(""))
    )
    return texts.select("conv_id", "token_count", F.concat(lead, body).alias("text"))


def instruct_projection(rows: DataFrame) -> DataFrame:
    """Source columns only, for tools that template the data themselves."""
    return rows.drop("text", "token_count")


# -- statistics -----------------------------------------------------------------


def length_stats(texts: DataFrame) -> DataFrame:
    c = F.col("token_count")
    return texts.agg(
        F.count(c).alias("entries"), F.max(c).alias("max_length"), F.min(c).alias("min_length"),
        F.avg(c).alias("avg_length"),
    )


def threshold_shares(
    texts: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, cap: int | None = None
) -> DataFrame:
    """Percentage of entries strictly below each threshold.

    With ``cap`` also of the entries that pass the cap, as a second stage of the
    same scan.
    """
    c = F.col("token_count")
    stages = {"original": c.isNotNull()} | ({"filtered": c < cap} if cap is not None else {})
    totals = [F.count_if(kept).alias(f"n_{s}") for s, kept in stages.items()]
    below = [F.count_if(kept & (c < t)).alias(f"b_{s}_{t}") for s, kept in stages.items() for t in thresholds]
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("stage"),
                F.lit(t).alias("threshold"),
                F.col(f"b_{s}_{t}").alias("below"),
                (F.try_divide(F.col(f"b_{s}_{t}"), F.col(f"n_{s}")) * 100).alias("percentage"),
            )
            for s in stages
            for t in thresholds
        ]
    )
    return texts.agg(*totals, *below).select(F.explode(rows).alias("_r")).select("_r.*")


def histogram(texts: DataFrame, bins: int = HISTOGRAM_BINS, cutoff: int | None = None) -> DataFrame:
    """Equal-width histogram of the token counts; empty bins are kept, the last bin is closed."""
    low, high = F.min("token_count"), F.max("token_count")
    same = low == high
    bounds = texts.agg(
        F.struct(
            F.when(same, low - 0.5).otherwise(low).cast("double").alias("low"),
            F.when(same, high + 0.5).otherwise(high).cast("double").alias("high"),
        ).alias("b")
    ).scalar()
    width = (F.col("b.high") - F.col("b.low")) / bins
    counted = (
        texts.where(F.col("token_count").isNotNull())
        .withColumn("b", bounds)
        .select(
            F.least(F.floor((F.col("token_count") - F.col("b.low")) / width), F.lit(bins - 1)).alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    axis = texts.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("b", bounds)
    out = axis.join(F.broadcast(counted), "bin", "left").select(  # one row per bin
        "bin",
        (F.col("b.low") + F.col("bin") * width).alias("bin_low"),
        (F.col("b.low") + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("entries"),
    )
    return out if cutoff is None else out.withColumn("cutoff", F.lit(cutoff))


def fixed_length_texts(rows: DataFrame, tokens: int, word: str = "token") -> DataFrame:
    """A text of exactly ``tokens`` tokens per row; the count is checked."""
    text = F.repeat(F.lit(word + " "), tokens - 1)
    exact = F.concat(text, F.lit(word))
    counted = rows.withColumn("text", exact).withColumn("token_count", token_count(F.col("text")))
    return require_rows(counted, F.col("token_count") == tokens, f"the text does not have {tokens} tokens")
