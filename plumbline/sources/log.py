"""The prediction log: JSON lines by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import text_length
from plumbline.session import path_exists
from plumbline.sources.schemas import PREDICTION_LOG

CORRUPT = "_corrupt_record"


def log_rows(df: DataFrame, timestamp: Column) -> DataFrame:
    """Scored rows as log rows; the timestamp is one per batch."""
    return df.select(
        timestamp.cast("timestamp").alias("timestamp"),
        F.col("text"),
        text_length("text").alias("text_length"),
        "sentiment",
        F.col("label").cast("int").alias("label"),
        "confidence",
        "model_used",
    )


def append_log(df: DataFrame, path: str, batch_ts: str) -> None:
    """Append a scored batch under its date, so that window reads list few folders."""
    rows = log_rows(df, F.lit(batch_ts))
    (
        rows.withColumn("log_date", F.to_date("timestamp"))
        .write.mode("append")
        .partitionBy("log_date")
        .json(path)
    )


def _read(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Log columns and the whole line where it cannot be parsed; of dated folders those from ``since`` on."""
    schema = T.StructType([*PREDICTION_LOG.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    if since is not None and "log_date" in lines.columns:
        lines = lines.where(F.col("log_date") >= F.to_date(since))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")


def read_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The log; unreadable lines are left out, a missing log is empty.

    ``since`` is a UTC time: folders of older dates are not even read.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], PREDICTION_LOG)
    start = None if since is None else F.lit(since).cast("timestamp")
    rows = _read(spark, path, start)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= start)
    return rows.where(F.col(CORRUPT).isNull()).select(*PREDICTION_LOG.names)


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that could not be read, whole."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{CORRUPT} string")
    return _read(spark, path).where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
