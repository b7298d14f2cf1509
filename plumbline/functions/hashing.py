"""Portable hash keys, the same in every SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_key(id_col: Column | str, seed: int) -> Column:
    """Uniform 32-digit key of a row id: sorting by it shuffles rows reproducibly."""
    source = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}-"), source.cast("string")))


def content_key(text: Column | str) -> Column:
    """SHA-256 of a whole text."""
    source = F.col(text) if isinstance(text, str) else text
    return F.sha2(source, 256)
