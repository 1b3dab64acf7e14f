"""Registered queries of the operators over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadscope.llm import (
    embedding_dedup,
    exact_dedup,
    html_extract,
    id_files,
    language_id,
    mixing,
    ngram_join,
    packing,
    secret_scan,
    source_divergence,
    token_alignment,
    token_counts,
    toxicity,
)
from loadscope.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


@_query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


@_query(
    "op3_exact_dedup",
    """
    with n as (
      select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
    ), g as (select norm, max(doc_id) as keep_id, count(*) as group_size from n group by norm)
    select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256
    from n join g using (norm)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"), keep="max")


@_query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@_query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


@_query("op6_html_extract")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query(
    "op8_mixing",
    r"""
    with recursive z as (
      select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
        md5(coalesce(cast(doc_id as varchar), '')) as h
      from documents
    ), a as (
      select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as no from z group by source
    ), b as (
      select *, case no % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2.0::double * source_size as most from a
    ), c as (
      select *, most / w as full_at from b
    ), d as (
      select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by full_at, no rows between unbounded preceding and 1 preceding), 0))
        / sum(w) over (order by full_at, no rows between current row and unbounded following) as level
      from c
    ), t as (
      select source, no, source_size, least(most, (select arg_min(level, (full_at, no)) from d where level <= full_at) * w) as target from d
    ), u as (
      select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t
    ), p as (
      select z.doc_id, z.size, u.no, source_size, target, whole, target - whole * source_size as missing,
        sum(size) over (partition by no order by h, doc_id, size rows unbounded preceding) as stop
      from z join u on z.source is not distinct from u.source
    ), g as (
      select no, max(missing) - coalesce(sum(size) filter (stop <= missing), 0) as gap from p group by no
    ), fill as (  -- the largest that fits, then in order what fits up to the first that does not, and again
      select no, gap, list({'stop': stop, 'size': size} order by stop) as rest, true as big, null::hugeint as stop
      from p join g using (no) where stop > missing and size > 0 and size <= gap group by no, gap
      union all
      select no, gap - case when x.size <= gap then x.size else 0 end,
        case when big then list_filter(rest, lambda y: y.stop <> x.stop and y.size <= gap - x.size)
          when x.size <= gap then rest[2:] else list_filter(rest, lambda y: y.size <= gap) end,
        x.size > gap, case when x.size <= gap then x.stop end
      from (
        select *, case when big then list_filter(rest, lambda y: y.size = list_max(list_transform(rest, lambda z: z.size)))[1] else rest[1] end as x
        from fill where len(rest) > 0
      )
    ), f as (select no, stop as fill from fill where stop is not null)
    select doc_id, size, cast(source_size as bigint) as source_size, target,
      cast(size * (whole + case when stop <= missing or (size > 0 and fill is not null) then 1 else 0 end) as bigint) as taken
    from p left join f on f.no = p.no and f.fill = p.stop
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.dealt(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query(
    "op9_embedding_dedup",
    """
    with recursive v as (
      select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
    ), g as (
      select vec_id, e from v
      where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
    ), l as (
      select a.vec_id as x, b.vec_id as y from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
    ), r as (select vec_id as node, vec_id as reach from v union select r.node, l.y from r join l on r.reach = l.x)
    select v.vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, v.vec_id = c.c as kept
    from v left join (select x, count(*) as n from l group by x) n on n.x = v.vec_id
    join (select node, min(reach) as c from r group by node) c on c.node = v.vec_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


@_query(
    "op10_ngram_jaccard",
    r"""
    with recursive w as (
      select doc_id, list_filter(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') as w
      from documents
    ), s as (
      select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end) as g
      from w
    ), n as (select doc_id, count(*) as n from s group by doc_id),
    o as (
      select a.doc_id as x, b.doc_id as y, count(*) as o
      from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
    ), e as (
      select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 90 * (a.n + b.n - o)
    ), l as (select x, y from e union select y, x from e),
    r as (select doc_id as node, doc_id as reach from documents union select r.node, l.y from r join l on r.reach = l.x)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
    from documents d left join n using (doc_id) join (select node as doc_id, min(reach) as component_id from r group by node) c using (doc_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


@_query("op11_id_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "id-files")
    id_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return id_files.read(spark, folder)


@_query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query(
    "op13_source_divergence",
    r"""
    with d as (
      select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
      from documents
    ), o as (select k, lang, source, unnest(w) as term from d),
    kept as (select lang, term from o group by all having count(distinct k) >= 30),
    v as (select lang, count(*) as v from kept group by lang),
    n as (select lang, source, term, count(*) as n from o join kept using (lang, term) group by all),
    g as (select distinct lang, source from d),
    dense as (
      select g.lang, g.source, kept.term, coalesce(n.n, 0) as n
      from g join kept using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = kept.term
    ), p as (
      select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source)::hugeint + 5 * v) as p from dense join v using (lang)
    ), q as (
      select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang)::hugeint + 5 * v) as q
      from (select lang, term, sum(n) as n from n group by all) join v using (lang)
    ), f as (
      select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
    ), pair as (
      select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
    ), term as (
      select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from p join q using (lang, term) where n > 0 and p > q
    ), r as (
      select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
      from (select * from pair union all select * from term)
    )
    select * from r where part = 'pair' or rank <= 50
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))
