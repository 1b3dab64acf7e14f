"""CSV logs, read by column name with fixed types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadscope import schemas
from loadscope.functions.names import profile_keys

FILE_PATH = "_metadata.file_path"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, *, with_path: bool = False) -> DataFrame:
    """The schema's columns by header name; other columns are never parsed.

    The header line gives only names; types come from the schema. Files whose
    headers differ are refused rather than read by position.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    absent = [f.name for f in schema.fields if f.name not in raw.columns]
    if absent:
        raise ValueError(f"columns missing in {path}: {', '.join(absent)}")
    cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
    return raw.select(*cols, *([F.col(FILE_PATH).alias("path")] if with_path else []))


def read_request_log(spark: SparkSession, path: str | list[str], models: list[str] | None = None) -> DataFrame:
    """Request-lifecycle log; with ``models`` the configuration in the file names as columns."""
    return _profiles(spark, path, schemas.REQUEST_LOG, models)


def read_step_log(spark: SparkSession, path: str | list[str], models: list[str] | None = None) -> DataFrame:
    """Step log. ``step_id`` is the split of a row and its position there: unique for equal rows too.

    It follows from the files and the size of splits alone, so every scan of a session, and one
    repeated after an executor is lost, gives a row the same one.
    """
    return _profiles(spark, path, schemas.STEP_LOG, models, row_id="step_id")


def _profiles(spark: SparkSession, path, schema: StructType, models: list[str] | None, row_id: str | None = None) -> DataFrame:
    log = read_csv(spark, path, schema, with_path=models is not None)
    if row_id is not None:
        log = log.withColumn(row_id, F.monotonically_increasing_id())
    log = log.withColumnRenamed("timestamp", "timestamp_us")
    if models is None:
        return log
    return log.withColumns(profile_keys(F.col("path"), models)).drop("path", "kind")


def read_arrival_log(spark: SparkSession, path: str) -> DataFrame:
    """Arrival times in microseconds since the first arrival."""
    log = read_csv(spark, path, schemas.ARRIVAL_LOG).select(F.unix_micros("TIMESTAMP").alias("t_us"))
    return log.withColumn("t_us", F.col("t_us") - log.agg(F.min("t_us").alias("m")).scalar())


def read_burst_log(spark: SparkSession, path: str, model: str = "ChatGPT") -> DataFrame:
    """Arrival times in seconds of one model's requests."""
    log = read_csv(spark, path, schemas.BURST_LOG)
    return log.where(F.col("Model") == model).select(F.col("Timestamp").alias("timestamp_s"))
