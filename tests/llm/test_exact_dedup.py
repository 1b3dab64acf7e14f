import hashlib
import re

from pyspark.sql import functions as F

from loadscope.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, lang string"


def expected(rows, keep):
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        known = [x for x in ids if x is not None]
        stays = keep(known) if known else None
        out.append((i, stays, len(ids), i == stays, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "Hello World"), (2, "hello world"), (3, "hello world "), (4, None), (5, ""), (6, "ÉTÉ A"), (7, "ÉTÉ a"), (8, "été a"),
    (9, "x" * 200_000), (10, "X" * 200_000), (11, "same"), (11, "same"), (12, "İSTANBUL"), (13, "İstanbul"), (None, "lone"), (None, "same"),
]


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    return df.withColumn("keep_id", F.lit(-1)).withColumn("h", F.lit("clash")).withColumn("norm", F.lit(0))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_groups_and_bytes(spark):
    assert result(exact_dedup.duplicates(frame(spark, ROWS))) == expected(ROWS, max)
    assert result(exact_dedup.duplicates(frame(spark, ROWS), keep="min")) == expected(ROWS, min)


def test_colliding_hashes_are_told_apart(spark):
    weak = lambda text: F.pmod(F.length(text), F.lit(3))
    assert result(exact_dedup.duplicates(frame(spark, ROWS), content_hash=weak)) == expected(ROWS, max)


def test_empty_table(spark):
    assert result(exact_dedup.duplicates(frame(spark, []))) == []


def test_unique_keeps_columns_and_clean_rows(spark):
    df = frame(spark, [r for r in ROWS if r[0] is not None])
    got = exact_dedup.unique(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 6, 8, 9, 11, 12]
