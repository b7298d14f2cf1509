"""Class scores: softmax, argmax and the two-model decision rule.

The class count is known when the plan is built, so everything is written as
flat expressions over the classes and stays inside generated code; array
lambdas would be interpreted row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import MODELS, label_name


def round_to(value: Column | str, digits: int) -> Column:
    """Round the double itself, half away from zero.

    ``round(x, digits)`` rounds the shortest decimal text of ``x`` instead and
    lifts values that only look like a tie.
    """
    source = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.round(source * scale) / scale


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Probabilities of the given logits, shifted by their maximum."""
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return [part / total for part in parts]


def argmax(values: Sequence[Column]) -> Column:
    """Index of the greatest value; the first one wins a tie."""
    top = F.greatest(*values)
    out = F.when(values[0] == top, F.lit(0))
    for i, value in enumerate(values[1:], start=1):
        out = out.when(value == top, F.lit(i))
    return out.cast("int")


def softmax_argmax(logits: Column | str, classes: int = 3) -> Column:
    """Struct ``(probs, pred, confidence)`` of an array of logits."""
    source = F.col(logits) if isinstance(logits, str) else logits
    items = [F.get(source, F.lit(i)) for i in range(classes)]
    probs = softmax(items)
    return F.struct(
        F.array(*probs).alias("probs"),
        argmax(items).alias("pred"),
        F.greatest(*probs).alias("confidence"),
    )


def decide(
    df: DataFrame,
    first: tuple[str, str] = ("social_pred", "social_conf"),
    second: tuple[str, str] = ("reviews_pred", "reviews_conf"),
    names: tuple[str, str] = MODELS,
) -> DataFrame:
    """Combine two models' predictions.

    When they agree the more confident model speaks, the first one on a tie.
    When they disagree the lower (more cautious) label wins, with the
    confidence of the model that gave it.
    """
    label_1, conf_1 = F.col(first[0]), F.col(first[1])
    label_2, conf_2 = F.col(second[0]), F.col(second[1])
    first_speaks = F.when(label_1 == label_2, conf_1 >= conf_2).otherwise(label_1 < label_2)
    return (
        df.withColumn("_first", first_speaks)
        .withColumn("label", F.when(F.col("_first"), label_1).otherwise(label_2).cast("int"))
        .withColumn(
            "confidence", round_to(F.when(F.col("_first"), conf_1).otherwise(conf_2), 4)
        )
        .withColumn("model_used", F.when(F.col("_first"), names[0]).otherwise(names[1]))
        .withColumn("sentiment", label_name("label"))
        .drop("_first")
    )
