"""Label recoding and label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class ids and their names.
LABEL_NAMES = {0: "negative", 1: "neutral", 2: "positive"}
SENTIMENTS = ("negative", "neutral", "positive")
# The two members of the scoring ensemble, first one wins ties.
MODELS = ("social", "reviews")


def recode(col: Column | str, mapping: dict[int, int]) -> Column:
    """Replace listed codes, let every other value (null too) pass through."""
    source = F.col(col) if isinstance(col, str) else col
    out = None
    for old, new in mapping.items():
        hit = source == F.lit(old)
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return source if out is None else out.otherwise(source)


def recode_stars(col: Column | str) -> Column:
    """Star scores: 1, 2 are negative, 3 is neutral, 4, 5 are positive."""
    return recode(col, {1: 0, 2: 0, 3: 1, 4: 2, 5: 2})


def recode_polarity(col: Column | str) -> Column:
    """Polarity codes: 0 is negative, 2 is neutral, 4 is positive."""
    return recode(col, {0: 0, 2: 1, 4: 2})


def label_name(col: Column | str) -> Column:
    """Class id to class name, null for an unknown id."""
    source = F.col(col) if isinstance(col, str) else col
    out = F.when(source == 0, "negative")
    for key in (1, 2):
        out = out.when(source == key, LABEL_NAMES[key])
    return out


def label_id(col: Column | str) -> Column:
    """Class name to class id, null for an unknown name."""
    source = F.col(col) if isinstance(col, str) else col
    out = F.when(source == "negative", F.lit(0))
    for key in (1, 2):
        out = out.when(source == LABEL_NAMES[key], F.lit(key))
    return out
