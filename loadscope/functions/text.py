"""Token counting and chat templating."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# An explicit class instead of \S: regular-expression engines disagree on \S.
TOKEN_PATTERN = r"[^ \t\n\r\f]+"


def token_count(text: Column, specials: int = 0) -> Column:
    """Number of blank-separated tokens plus ``specials`` added by the tokenizer."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN)) + F.lit(specials)


def tokenizer_counter(load: Callable[[], Callable[[list[str]], list[int]]]):
    """Plug in a real tokenizer: ``load`` runs once per Python worker.

    ``load()`` returns a function from a batch of texts to their token counts.
    """
    state: dict[str, Callable[[list[str]], list[int]]] = {}

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if "fn" not in state:
            state["fn"] = load()
        return pd.Series(state["fn"](texts.fillna("").tolist()), dtype="int32")

    return count


@dataclass(frozen=True)
class ChatTemplate:
    """A chat template as four strings around role and content."""

    head: str = "<|im_start|>"
    sep: str = "\n"
    end: str = "<|im_end|>\n"
    reply_role: str = "assistant"

    @property
    def counts_add_up(self) -> bool:
        """Blank-separated counts of the parts sum to that of the whole text."""
        return self.end[-1:] in tuple(" \t\n\r\f") and self.end != ""

    def message(self, role: Column, content: Column) -> Column:
        return F.concat(F.lit(self.head), role, F.lit(self.sep), content, F.lit(self.end))

    def reply_header(self) -> Column:
        return F.lit(f"{self.head}{self.reply_role}{self.sep}")

    def user_prompt(self, prompt: Column) -> Column:
        """One user message followed by the header that asks for the reply."""
        return F.concat(self.message(F.lit("user"), prompt), self.reply_header())

    def exchange(self, prompt: Column, response: Column) -> Column:
        return F.concat(
            self.message(F.lit("user"), prompt), self.message(F.lit(self.reply_role), response)
        )

    def messages(self, turns: Column, system: Column | None = None) -> Column:
        """A whole array of ``struct(from, value)`` turns, system text first."""
        body = F.array_join(
            F.transform(turns, lambda t: self.message(t["from"], t["value"])), ""
        )
        if system is None:
            return body
        return F.concat(self.message(F.lit("system"), system), body)
