"""The action list: the most certain negative rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.prepare import select_available

# Share of the negatives, longest list, and its columns.
ACTION_SHARE = 0.10
ACTION_CAP = 1000
ACTION_COLUMNS = (
    "customer_id", "customer_name", "phone_number", "text", "sentiment", "confidence", "model_used",
)


def action_rows(
    df: DataFrame, id_col: str = "row_id", share: float = ACTION_SHARE, cap: int = ACTION_CAP
) -> DataFrame:
    """The top share of the negatives by confidence, at least one, at most ``cap``.

    ``rank`` numbers the rows; ties are ordered by id. The cap is part of the
    report, so a distributed top-k bounded by it comes first and the share is
    applied to that short list.
    """
    negatives = df.where(F.col("sentiment") == "negative")
    best = [F.col("confidence").desc(), F.col(id_col)]
    shortlist = negatives.orderBy(*best).limit(cap)
    wanted = negatives.agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).cast("double") * F.lit(share))).alias("k")
    ).scalar()
    # At most `cap` rows reach this window.
    ranked = shortlist.withColumn("rank", F.row_number().over(Window.orderBy(*best)))
    return ranked.where(F.col("rank") <= wanted)


def action_list(
    df: DataFrame, id_col: str = "row_id", share: float = ACTION_SHARE, cap: int = ACTION_CAP
) -> DataFrame:
    """The action list with its available report columns; no negatives, no rows."""
    return select_available(action_rows(df, id_col, share, cap).orderBy("rank"), ACTION_COLUMNS)


def action_share(kept: DataFrame, total_rows: int) -> float:
    """Size of the list in percent of the input, two decimals."""
    return round(100.0 * kept.count() / total_rows, 2) if total_rows else 0.0
