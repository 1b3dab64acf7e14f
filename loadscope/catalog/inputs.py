"""The operators' inputs, derived from the given tables, in Spark and in SQL.

Each derived view exists twice: as a property of :class:`Inputs` and as an entry of
``VIEWS``. Both build the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Fixed values of the derived inputs, the same in Spark and SQL.
FIRST_GUID = 1_000_000
WARMUP_USERS = 10
EPOCH_US = 1_704_067_200_000_000


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- logs ---------------------------------------------------------------

    @property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            "user_id",
            "event_type",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @property
    def request_log(self) -> DataFrame:
        """A request is one user's events in order: a request's marks are few, whatever the table."""
        events = self.events.select("user_id", "t", "event_id")
        own = W.partitionBy("user_id").orderBy("t", "event_id")
        marks = events.withColumns({"rn": F.row_number().over(own), "previous_us": F.lag("t").over(own)})
        user = F.col("user_id")
        return marks.select(
            (F.lit(FIRST_GUID) + user).cast("bigint").alias("request_guid"),
            F.when(user < WARMUP_USERS, 1).otherwise(0).alias("is_warmup_request"),
            (F.col("rn") - 3).cast("int").alias("decoding_step_idx"),
            F.col("t").alias("timestamp_us"),
            "previous_us",
            F.when(user % 2 == 0, "sharegpt").otherwise("wildchat").alias("dataset"),
            F.when(F.floor(user / 2) % 2 == 0, "model_a").otherwise("model_b").alias("model"),
            F.when(user % 3 == 0, 128).when(user % 3 == 1, 256).otherwise(1024).alias("max_tokens_per_batch"),
            F.when(F.floor(user / 3) % 2 == 0, 64).otherwise(256).alias("max_batch_size"),
        )

    @property
    def step_log(self) -> DataFrame:
        run = (F.col("event_id") % 26).cast("int")
        backward = F.floor(F.col("event_id") / 26) % 2 == 1
        return self.events.select(
            F.col("event_id").alias("step_id"),
            F.col("t").alias("timestamp_us"),
            run.alias("run_idx"),
            F.when(F.col("k") % 10 == 0, 1).otherwise(0).alias("is_warmup_step"),
            F.when(F.col("event_type") == "error", 0)
            .when(F.col("event_type") == "purchase", F.col("k"))
            .otherwise(256)
            .alias("num_decoding_tokens"),
            F.when(F.col("event_type") == "view", F.col("k")).otherwise(0).alias("num_prefilling_tokens"),
            F.when((run > 0) & ~backward, (F.floor((run - 1) / 5) * 1024).cast("int"))
            .otherwise(0)
            .alias("num_finetuning_fwd_tokens"),
            F.when(backward, 4096).otherwise(0).alias("num_finetuning_bwd_tokens"),
            F.when((run > 0) & backward, ((run - 1) % 5 * 8).cast("int")).otherwise(0).alias("num_bwd_layers"),
        )

    @property
    def ft_log(self) -> DataFrame:
        half = F.floor(F.col("event_id") / 2)
        tokens = (64 * (1 + half % 8)).cast("int")
        even = F.col("event_id") % 2 == 0
        return self.events.select(
            F.col("event_id").alias("step_id"),
            F.col("t").alias("timestamp_us"),
            (half % 3).cast("int").alias("run_idx"),
            F.when(half % 10 == 0, 1).otherwise(0).alias("is_warmup_step"),
            F.when(even, tokens).otherwise(0).alias("num_finetuning_fwd_tokens"),
            F.when(~even, tokens).otherwise(0).alias("num_finetuning_bwd_tokens"),
        )

    @property
    def arrival_log(self) -> DataFrame:
        rebased = F.floor((F.col("t") - F.lit(EPOCH_US)) / F.lit(1000)).cast("bigint")
        return self.events.select("event_id", rebased.alias("t_us"))

    @property
    def burst_log(self) -> DataFrame:
        chat = F.col("event_type").isin("click", "view")
        t_us = F.floor((F.col("t") - F.lit(EPOCH_US)) / F.lit(1000)).cast("bigint")
        return self.events.select(
            "event_id",
            (t_us / F.lit(1e6)).alias("timestamp_s"),
            F.when(chat, "ChatGPT").otherwise("GPT-4").alias("model"),
        )

    # -- corpora ------------------------------------------------------------

    @property
    def turns(self) -> DataFrame:
        """Conversation turns with the corpus role names."""
        role = F.col("role")
        return self.table("conversations").select(
            "conv_id",
            F.col("turn").cast("int").alias("turn"),
            F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role).alias("from"),
            F.col("text").alias("value"),
        )

    @property
    def pairs(self) -> DataFrame:
        """Adjacent user and assistant turns; the join key (conv_id, turn) is unique."""
        turns = self.table("conversations")
        asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
        told = turns.where("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
        )
        return asked.join(told, ["conv_id", "turn"])

    @property
    def chat_corpus(self) -> DataFrame:
        conv = F.col("conv_id")
        return self.pairs.select(
            (conv * 100 + F.col("turn")).cast("bigint").alias("id"),
            F.when(conv % 3 == 0, "gpt-3.5").otherwise("gpt-4").alias("model"),
            F.when(F.col("turn") <= 2, 1).otherwise(2).alias("turn"),
            F.when(conv % 4 == 3, "French").otherwise("English").alias("language"),
            F.array(
                F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
                F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")),
            ).alias("conversation"),
        )

    @property
    def qa_corpus(self) -> DataFrame:
        system = self.table("conversations").where("turn = 0 and role = 'system'").select(
            "conv_id", F.col("text").alias("system")
        )
        row_id = (F.col("conv_id") * 100 + F.col("turn")).cast("bigint")
        kinds = F.array(*[F.lit(c) for c in ("open_qa", "closed_qa", "brainstorming", "general_qa")])
        return self.pairs.join(system, "conv_id", "left").select(
            row_id.alias("id"),
            F.get(kinds, (row_id % 4).cast("int")).alias("category"),
            F.coalesce("system", F.lit("")).alias("context"),
            F.col("prompt").alias("instruction"),
            "response",
        )

    @property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    # -- client records -----------------------------------------------------

    @property
    def client_output(self) -> DataFrame:
        guid, idx, ts = F.col("request_guid"), F.col("decoding_step_idx"), F.col("timestamp_us")
        requests = (
            self.request_log.where("is_warmup_request = 0")
            .groupBy("request_guid")
            .agg(
                F.min(F.when(idx == 0, ts)).alias("t0"),
                F.min(F.when(idx == -1, ts)).alias("ts"),
                F.max(ts).alias("te"),
                F.count_if(idx >= 0).alias("tokens"),
            )
        )
        conversations = self.table("conversations")
        count = conversations.agg(F.count_distinct("conv_id").alias("n")).scalar()
        replies = conversations.where("turn = 1").select("conv_id", F.col("text").alias("generated_text"))
        keyed = requests.withColumn("n_conv", count).withColumn("conv_id", guid % F.col("n_conv"))
        return keyed.join(replies, "conv_id", "left").select(
            guid.alias("request_id"),
            (guid % 7 != 0).alias("success"),
            (50 + guid % 200).cast("int").alias("prompt_len"),
            F.when(guid % 11 == 0, F.lit(None)).when(guid % 13 == 0, 1).otherwise(F.col("tokens")).cast("int").alias("output_tokens"),
            ((F.col("t0") - F.col("ts")) / F.lit(1e6)).alias("ttft_s"),
            ((F.col("te") - F.col("ts")) / F.lit(1e6)).alias("latency_s"),
            "generated_text",
        )

    @property
    def token_gaps(self) -> DataFrame:
        """Inter-token gaps as rows: one request may have any number of tokens."""
        guid = F.col("request_guid")
        return self.request_log.where("is_warmup_request = 0 and decoding_step_idx >= 1").select(
            guid.alias("request_id"),
            (guid % 7 != 0).alias("success"),
            ((F.col("timestamp_us") - F.col("previous_us")) / F.lit(1e6)).alias("itl_s"),
        )

    @property
    def duration_s(self):
        """Length of the log in seconds, as a scalar column."""
        span = (F.max("timestamp_us") - F.min("timestamp_us")) / F.lit(1e6)
        return self.request_log.agg(span.alias("dur_s")).scalar()



def sql_hash(row_id: str, salt) -> str:
    return f"('0x' || substr(md5({row_id} || ':{salt}'),1,13))::BIGINT"


def sql_uniform(row_id: str, salt) -> str:
    return f"(({sql_hash(row_id, salt)} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def sql_tokens(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[^ \t\n\r\f]+'))"


VIEWS: dict[str, str] = {
    "ev": """
        select event_id, user_id, event_type, epoch_us(ts) as t,
               cast(json_extract(props, '$.k') as int) as k
        from events""",
    "request_log": """
        select (1000000 + user_id)::bigint as request_guid,
               case when user_id < 10 then 1 else 0 end as is_warmup_request,
               (row_number() over (partition by user_id order by t, event_id) - 3)::int as decoding_step_idx,
               t as timestamp_us,
               lag(t) over (partition by user_id order by t, event_id) as previous_us,
               case when user_id % 2 = 0 then 'sharegpt' else 'wildchat' end as dataset,
               case when (user_id // 2) % 2 = 0 then 'model_a' else 'model_b' end as model,
               case user_id % 3 when 0 then 128 when 1 then 256 else 1024 end as max_tokens_per_batch,
               case when (user_id // 3) % 2 = 0 then 64 else 256 end as max_batch_size
        from ev""",
    "step_log": """
        select event_id as step_id, t as timestamp_us, (event_id % 26)::int as run_idx,
               case when k % 10 = 0 then 1 else 0 end as is_warmup_step,
               case event_type when 'error' then 0 when 'purchase' then k else 256 end as num_decoding_tokens,
               case event_type when 'view' then k else 0 end as num_prefilling_tokens,
               case when event_id % 26 > 0 and (event_id // 26) % 2 = 0
                    then ((event_id % 26 - 1) // 5 * 1024)::int else 0 end as num_finetuning_fwd_tokens,
               case when (event_id // 26) % 2 = 1 then 4096 else 0 end as num_finetuning_bwd_tokens,
               case when event_id % 26 > 0 and (event_id // 26) % 2 = 1
                    then ((event_id % 26 - 1) % 5 * 8)::int else 0 end as num_bwd_layers
        from ev""",
    "ft_log": """
        select event_id as step_id, t as timestamp_us, ((event_id // 2) % 3)::int as run_idx,
               case when (event_id // 2) % 10 = 0 then 1 else 0 end as is_warmup_step,
               case when event_id % 2 = 0 then (64 * (1 + (event_id // 2) % 8))::int else 0 end as num_finetuning_fwd_tokens,
               case when event_id % 2 = 1 then (64 * (1 + (event_id // 2) % 8))::int else 0 end as num_finetuning_bwd_tokens
        from ev""",
    "arrival_log": """
        select event_id, (t - 1704067200000000) // 1000 as t_us from ev""",
    "burst_log": """
        select event_id, ((t - 1704067200000000) // 1000) / 1000000::double as timestamp_s,
               case when event_type in ('click', 'view') then 'ChatGPT' else 'GPT-4' end as model
        from ev""",
    "turns": """
        select conv_id, turn::int as turn,
               case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as "from",
               text as value
        from conversations""",
    "pairs": """
        select conv_id, turn, text as prompt, reply as response
        from (select *, lead(text) over w as reply, lead(role) over w as reply_role
              from conversations window w as (partition by conv_id order by turn))
        where role = 'user' and reply_role = 'assistant'""",
    "exchange": """
        select a.conv_id, a.value as prompt, b.value as response
        from turns a join turns b on a.conv_id = b.conv_id
        where a.turn = 0 and b.turn = 1 and a."from" = 'human' and b."from" = 'gpt'""",
    "chat_corpus": """
        select (conv_id * 100 + turn)::bigint as id,
               case when conv_id % 3 = 0 then 'gpt-3.5' else 'gpt-4' end as model,
               case when turn <= 2 then 1 else 2 end as turn,
               case when conv_id % 4 = 3 then 'French' else 'English' end as language,
               prompt, response
        from pairs""",
    "qa_corpus": """
        select (p.conv_id * 100 + p.turn)::bigint as id,
               case (p.conv_id * 100 + p.turn) % 4 when 0 then 'open_qa' when 1 then 'closed_qa'
                    when 2 then 'brainstorming' else 'general_qa' end as category,
               coalesce(s.text, '') as context, p.prompt as instruction, p.response
        from pairs p left join conversations s
          on s.conv_id = p.conv_id and s.turn = 0 and s.role = 'system'""",
    "client_output": f"""
        select g.request_guid as request_id, g.request_guid % 7 <> 0 as success,
               (50 + g.request_guid % 200)::int as prompt_len,
               (case when g.request_guid % 11 = 0 then null when g.request_guid % 13 = 0 then 1
                     else g.tokens end)::int as output_tokens,
               (g.t0 - g.ts) / 1000000::double as ttft_s, (g.te - g.ts) / 1000000::double as latency_s,
               c.text as generated_text,
               case when not (g.request_guid % 7 <> 0) then 0
                    when g.request_guid % 11 = 0 then coalesce({sql_tokens('c.text')}, 0)
                    when g.request_guid % 13 = 0 then 1 else g.tokens end as output_len
        from (select request_guid, min(timestamp_us) filter (decoding_step_idx = 0) as t0,
                     min(timestamp_us) filter (decoding_step_idx = -1) as ts,
                     max(timestamp_us) as te, count(*) filter (decoding_step_idx >= 0) as tokens
              from request_log where is_warmup_request = 0 group by 1) g
        cross join (select count(distinct conv_id) as n from conversations) n
        left join conversations c on c.turn = 1 and c.conv_id = g.request_guid % n.n""",
    "token_gaps": """
        select request_guid as request_id, request_guid % 7 <> 0 as success,
               (timestamp_us - previous_us) / 1000000::double as itl_s
        from request_log where is_warmup_request = 0 and decoding_step_idx >= 1""",
    "dur": """
        select (max(timestamp_us) - min(timestamp_us)) / 1000000::double as dur_s from request_log""",
}

_ORDER = list(VIEWS)


def _names_in(sql: str) -> set[str]:
    return {v for v in _ORDER if re.search(rf"\b{v}\b", sql)}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the derived views it uses, in dependency order."""
    needed: set[str] = set()
    todo = _names_in(sql)
    while todo:
        view = todo.pop()
        if view not in needed:
            needed.add(view)
            todo |= _names_in(VIEWS[view]) - {view}
    parts = [f"{v} as ({VIEWS[v].strip()})" for v in _ORDER if v in needed]
    body = sql.strip()
    if not parts:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
