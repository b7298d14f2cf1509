"""Labelled-text preparation: projections and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return df.dropna(subset=list(cols))


def to_labelled(df: DataFrame, text_col: str, label: Column | str) -> DataFrame:
    """Keep the two role columns as ``text`` and ``label``."""
    source = F.col(label) if isinstance(label, str) else label
    return df.select(F.col(text_col).alias("text"), source.cast("int").alias("label"))


def select_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in cols if c in df.columns])


def with_text(df: DataFrame) -> DataFrame:
    """An upload with a ``text`` column: its own, or a copy of its first column.

    Unlike ``upload_text`` every column keeps its name; the copy remembers in
    its metadata where it comes from, so that the export can leave it out.
    """
    if "text" in df.columns:
        return df.where(F.col("text").isNotNull()).withColumn("text", F.col("text").cast("string"))
    first = F.col(f"`{df.columns[0]}`")
    return df.where(first.isNotNull()).withColumn("text", first.cast("string").alias("text", metadata={"copy_of": df.columns[0]}))


def upload_text(df: DataFrame) -> DataFrame:
    """Name the text column ``text``: the one of that name, else the first one.

    Rows without a text are dropped, the other columns pass through.
    """
    text_col = "text" if "text" in df.columns else df.columns[0]
    kept = df.where(F.col(text_col).isNotNull())
    return kept.select(
        *[
            F.col(c).cast("string").alias("text") if c == text_col else F.col(c)
            for c in df.columns
        ]
    )
