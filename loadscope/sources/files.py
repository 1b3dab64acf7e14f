"""Traces, text sets and result files: writing and reading back."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope import schemas
from loadscope.functions.names import result_keys
from loadscope.operators.client import BULKY_FIELDS

#: Tasks that write the rows of one name.
WRITERS = 16

_ENTRY = [f.name for f in schemas.TRACE_ENTRY.fields]


def write_trace(entries: DataFrame, metadata: DataFrame, path: str) -> None:
    """A folder with the entries as JSON lines, written in parallel, and the metadata."""
    entries.select("ordinal", *_ENTRY).write.json(f"{path}/entries")
    metadata.write.json(f"{path}/metadata")


def read_trace(spark: SparkSession, path: str, max_requests: int | None = None) -> DataFrame:
    """The first requests in list order: ``ordinal, prompt, prompt_len, expected_output_len``; the position is stored with every entry."""
    schema = "ordinal bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.TRACE_ENTRY.fields)
    return _head(spark.read.schema(schema).json(f"{path}/entries"), max_requests)


def _head(entries: DataFrame, max_requests: int | None) -> DataFrame:
    if max_requests is not None:
        entries = entries.where(F.col("ordinal") < max_requests)
    return entries.select(
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "prompt",
        F.col("prompt_length").alias("prompt_len"),
        F.col("response_length").alias("expected_output_len"),
    )


def write_texts(texts: DataFrame, path: str) -> None:
    """One JSON object per text and line, so that texts may hold line breaks."""
    texts.select("text").write.json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string").json(path)


def write_record(record: DataFrame, path: str) -> None:
    """A run record without the fields that hold one value per request."""
    record.drop(*BULKY_FIELDS).write.json(path)


def read_results(spark: SparkSession, path: str | list[str], models: list[str]) -> DataFrame:
    """Result files with the keys in their names."""
    raw = spark.read.schema(schemas.SERVING_RESULT).option("multiLine", True).json(path)
    named = raw.select("*", F.col("_metadata.file_path").alias("path"))
    return named.withColumns(result_keys(F.col("path"), models)).drop("path")


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, written in parallel."""
    rows.write.json(path)


def write_named(rows: DataFrame, name: str, folder: str, kind: str, *, writers: int = WRITERS, **options) -> None:
    """Files named by a column, as tools with keys in file names expect.

    A name with many rows is written by up to ``writers`` tasks, and a task may cut its
    rows into several files. The first file has the name itself, the others have
    ``_part_1`` and so on before the extension. Files are renamed, not copied; a rename that
    fails, or would replace a file, raises and leaves the staged files in place. The number of names is that of the
    configurations of a sweep.
    """
    staged = f"{folder}/_staged"
    salted = rows.withColumn("_writer", F.spark_partition_id() % writers).repartition(name, "_writer").drop("_writer")
    salted.write.partitionBy(name).format(kind).options(**options).save(staged)
    context = rows.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path
    files = place(staged).getFileSystem(context._jsc.hadoopConfiguration())
    for part in files.listStatus(place(staged)):
        if not part.isDirectory():
            continue
        stem, dot, extension = unquote(part.getPath().getName().partition("=")[2]).rpartition(".")
        found = sorted((f.getPath().getName(), f.getPath()) for f in files.listStatus(part.getPath()) if f.getPath().getName().startswith("part-"))
        for k, (_, file) in enumerate(found):
            target = place(f"{folder}/{stem}{f'_part_{k}' if k else ''}{dot}{extension}")
            if files.exists(target) or not files.rename(file, target):
                raise OSError(f"could not rename {file} to {target}")
    files.delete(place(staged), True)
