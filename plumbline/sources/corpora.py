"""Labelled corpora: raw CSV files in, train/val/test splits out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.prepare import drop_missing
from plumbline.operators.split import split_counts
from plumbline.sources.schemas import SOCIAL


def _quoted(spark: SparkSession, encoding: str, multi_line: bool):
    """CSV with doubled quotes; with ``multi_line`` also line breaks inside quotes.

    Such files cannot be split, so each is read by one task: a corpus in one
    very large file without quoted line breaks is better read without.
    """
    return (
        spark.read.option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )


def read_social_csv(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = True
) -> DataFrame:
    """The headerless six-column social corpus."""
    return _quoted(spark, encoding, multi_line).schema(SOCIAL).csv(path)


def read_reviews_csv(
    spark: SparkSession,
    path: str,
    text_col: str = "Text",
    label_col: str = "Score",
    encoding: str = "UTF-8",
    multi_line: bool = True,
) -> DataFrame:
    """Text and integer score of a headed corpus; rows missing either are dropped."""
    raw = _quoted(spark, encoding, multi_line).option("header", True).csv(path)
    kept = raw.select(F.col(text_col), F.col(label_col).cast("int").alias(label_col))
    return drop_missing(kept, [text_col, label_col])


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write text and label by split and return the rows written per split."""
    out = df.select("text", F.col("label").cast("int").alias("label"), "split")
    writer = out.write.mode("overwrite").partitionBy("split").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
    return split_counts(_splits(df.sparkSession, path, fmt))


def _splits(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.schema("text string, label int, split string")
    if fmt == "csv":
        return (
            reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        )
    return reader.format(fmt).load(path)


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """One split; only its partition is listed and read."""
    return _splits(spark, path, fmt).where(F.col("split") == split).select("text", "label")
