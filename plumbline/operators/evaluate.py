"""Evaluation from one confusion matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.small import fitted


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """``label, pred, n``: the only pass over the rows.

    Rows without a label or prediction are dropped by their count: a filter on
    the prediction would be pushed below the scorer and run it twice.
    """
    both = F.when(F.col(label).isNotNull(), F.col(pred))
    return (
        df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred"))
        .agg(F.count(both).alias("n"))
        .where(F.col("n") > 0)
    )


def class_counts(matrix: DataFrame) -> DataFrame:
    """``class, support, predicted, hits`` of every class seen as label or prediction."""
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p")),
        )
    ).alias("c")
    hit = F.when(F.col("label") == F.col("pred"), F.col("c.s")).otherwise(0)
    return (
        matrix.select("label", "pred", sides)
        .select("c.class", "c.s", "c.p", hit.alias("h"))
        .groupBy("class")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    )


def evaluate_overall(matrix: DataFrame) -> DataFrame:
    """``metric, value``: accuracy and F1 weighted by support."""
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("hits"), (F.col("support") + F.col("predicted")).cast("double")),
        F.lit(0.0),
    )
    totals = class_counts(matrix).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"),
    )
    return totals.select(
        F.expr("stack(2, 'test_accuracy', accuracy, 'test_f1', f1) as (metric, value)")
    )


def evaluate_per_class(matrix: DataFrame, labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """``class, precision, recall`` of the given labels; 0 where undefined."""
    sums = [
        F.sum(F.when((F.col("label") == c) & (F.col("pred") == c), F.col("n")).otherwise(0)).alias(f"h{c}")
        for c in labels
    ]
    sums += [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"s{c}") for c in labels]
    sums += [F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"p{c}") for c in labels]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    F.coalesce(F.try_divide(F.col(f"h{c}"), F.col(f"p{c}")), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide(F.col(f"h{c}"), F.col(f"s{c}")), F.lit(0.0)).alias("recall"),
                )
                for c in labels
            ]
        )
    ).alias("r")
    return matrix.agg(*sums).select(rows).select("r.*")


def evaluation_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Long report ``metric, class, value`` with values at four decimals."""
    # One row per pair of classes: counted once, so the rows are scored once.
    matrix = fitted(confusion_matrix(df, label, pred)).df
    overall = evaluate_overall(matrix).select(
        "metric", F.lit(None).cast("int").alias("class"), "value"
    )
    per_class = evaluate_per_class(matrix).select(
        F.expr("stack(2, 'precision', class, precision, 'recall', class, recall) as (metric, class, value)")
    )
    return overall.unionByName(per_class).withColumn("value", F.round("value", 4))
