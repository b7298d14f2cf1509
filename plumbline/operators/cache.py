"""Reuse of earlier scores by content key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import content_key
from plumbline.plans.small import lookup_join


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``content_key``, the SHA-256 of the whole text."""
    return df.withColumn("content_key", content_key(text_col))


def cache_miss(rows: DataFrame, scored: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The first row of every distinct text that has no score yet.

    Copies collapse to one id per task before the shuffle, so a text repeated
    in a third of all rows makes no hot key, and only ids and keys are
    compared; texts are fetched for the rows that remain.
    """
    keyed = rows.select(id_col, content_key(text_col).alias("content_key"))
    once = keyed.where(F.col("content_key").isNotNull()).groupBy("content_key").agg(
        F.min(id_col).alias(id_col)
    )
    missing = once.join(scored.select("content_key"), "content_key", "left_anti")
    return rows.join(missing, id_col)


def cache_hit(rows: DataFrame, scored: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Every input row whose text is scored, with its stored score.

    ``scored`` has one row per key.
    """
    keyed = with_key(rows, text_col).drop(text_col)
    return lookup_join(keyed, scored, "content_key", spread=F.col(id_col))
