"""Stored embeddings by content: a text is encoded once, on however many days and in however many rows it occurs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import content_key
from plumbline.plans.small import likely, written
from plumbline.session import path_exists

STORED = "content_key string, embedding array<double>, encoder string, batch string"


def load_embeddings(spark: SparkSession, path: str, encoder: str) -> DataFrame:
    """``content_key, embedding, batch`` of one encoder; only its folders are read."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED).drop("encoder")
    return spark.read.schema(STORED).parquet(path).where(F.col("encoder") == encoder).drop("encoder")


def add_embeddings(
    rows: DataFrame,
    path: str,
    encoder: str,
    encode: Callable[[DataFrame], DataFrame],
    batch: str,
    text: str = "text",
    texts: DataFrame | None = None,
) -> None:
    """Encode the texts of ``rows`` that the store lacks and add them as ``batch``.

    Rows that refer to a table of texts need not carry them: with ``texts`` (``content_key, text``)
    they carry a ``content_key``, the new keys are found first and each text is read where it lies.
    Copies collapse to one row per task before the shuffle; of the store only keys are read.
    A batch that runs again replaces itself, so a job that died half way is simply repeated.
    Null texts are left out, the empty text is a text.
    """
    known = load_embeddings(rows.sparkSession, path, encoder).where(F.col("batch") != batch).select("content_key")
    if texts is None:
        texts = rows.select(content_key(text).alias("content_key"), F.col(text).alias("text"))
        once = _distinct(texts).join(known, "content_key", "left_anti")
    else:
        asked = rows.select("content_key").where(F.col("content_key").isNotNull()).distinct()
        lacking = written(asked.join(known, "content_key", "left_anti"), "new-keys")
        # An inner join, as these keys are distinct: a semi join would be planned below the filter.
        once = _distinct(likely(texts, lacking, "content_key").join(lacking, "content_key"))
    new = encode(once)
    (
        new.select(
            "content_key",
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.lit(encoder).alias("encoder"),
            F.lit(batch).alias("batch"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("encoder", "batch")
        .parquet(path)
    )


def _distinct(texts: DataFrame) -> DataFrame:
    """One row per text. Texts are keys of the grouping: an aggregate of them would sort every copy."""
    return texts.select("content_key", "text").where(F.col("text").isNotNull()).distinct()


def embeddings_of(keys: DataFrame, path: str, encoder: str) -> DataFrame:
    """``content_key, embedding`` of the distinct keys in ``keys``; of a key stored twice the later batch counts."""
    wanted = keys.select("content_key").where(F.col("content_key").isNotNull()).distinct()
    found = load_embeddings(keys.sparkSession, path, encoder).join(wanted, "content_key", "left_semi")
    return found.groupBy("content_key").agg(F.max_by("embedding", "batch").alias("embedding"))
