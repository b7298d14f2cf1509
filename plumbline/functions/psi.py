"""Population Stability Index: smoothing, risk levels and alert state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import round_to

# Smoothing floor, level cuts, full-risk mark and alert mark.
EPSILON = 1e-4
LOW, MEDIUM, HIGH = 0.1, 0.2, 0.3
FULL_RISK = 0.3
ALERT = 0.25


def valid_number(col: Column | str) -> Column:
    """Neither null nor NaN."""
    source = (F.col(col) if isinstance(col, str) else col).cast("double")
    return source.isNotNull() & ~F.isnan(source)


def smooth(dist: Column | str, by: Sequence[str]) -> Column:
    """Raise every share to the floor and renormalise within ``by``.

    Runs over bin-sized frames: one window partition holds the bins of one
    distribution.
    """
    source = F.col(dist) if isinstance(dist, str) else dist
    floored = F.greatest(source, F.lit(EPSILON))
    return floored / F.sum(floored).over(Window.partitionBy(*by))


def psi(bins: DataFrame, by: Sequence[str], expected: str = "expected", actual: str = "actual") -> DataFrame:
    """One ``psi`` per ``by`` from a frame of bins with both shares."""
    smoothed = bins.select(
        *by, smooth(expected, by).alias("_p"), smooth(actual, by).alias("_q")
    )
    term = (F.col("_q") - F.col("_p")) * F.ln(F.col("_q") / F.col("_p"))
    return smoothed.groupBy(*by).agg(F.sum(term).alias("psi"))


def psi_level(col: Column | str) -> Column:
    """Level of an unrounded PSI; ``unknown`` without one."""
    source = F.col(col) if isinstance(col, str) else col
    return (
        F.when(source.isNull(), "unknown")
        .when(source < LOW, "low")
        .when(source < MEDIUM, "medium")
        .when(source < HIGH, "high")
        .otherwise("critical")
    )


def risk_pct(col: Column | str) -> Column:
    """PSI as a share of the full-risk mark in percent, 0 to 100, one decimal."""
    source = F.col(col) if isinstance(col, str) else col
    scaled = F.least(F.greatest(source / F.lit(FULL_RISK) * F.lit(100.0), F.lit(0.0)), F.lit(100.0))
    return F.coalesce(round_to(scaled, 1), F.lit(0.0))


def drift_status(psi_col: Column | str, rows: Column | str) -> Column:
    """``ALERT`` / ``OK``, or why there is no score."""
    score = F.col(psi_col) if isinstance(psi_col, str) else psi_col
    n = F.col(rows) if isinstance(rows, str) else rows
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "no_predictions")
        .when(score.isNull(), "no_baseline")
        .when(score >= ALERT, "ALERT")
        .otherwise("OK")
    )


def with_risk(df: DataFrame, col: str = "psi") -> DataFrame:
    """Add level and risk from the unrounded score, then round it to 4 decimals."""
    return (
        df.withColumn("level", psi_level(col))
        .withColumn("risk_pct", risk_pct(col))
        .withColumn(col, round_to(col, 4))
    )
