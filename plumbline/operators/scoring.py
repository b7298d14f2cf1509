"""Scorers, the two-model ensemble over texts, and class-weighted training."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scores import argmax, decide
from plumbline.functions.text import SPACE_PATTERN
from plumbline.plans.small import written
from plumbline.session import path_exists

# Class weights of the training loss.
CLASS_WEIGHTS = {0: 1.1, 1: 1.0, 2: 1.0}
CLASSES = 3


def evaluated_once(value: Column) -> Column:
    """Keep filters on a model's outcome above the model.

    A filter that moves below a projection takes a copy of its expressions
    along, here the whole model. Projections with a random term stay put; the
    term itself is always true.
    """
    return F.when(F.rand() * 0.0 < 1.0, value)


class Scorer(Protocol):
    """Adds a probability array named ``{name}_probs`` to a frame with a text column."""

    def probabilities(self, df: DataFrame, name: str, text_col: str) -> DataFrame: ...


class PipelineScorer:
    """A fitted ML pipeline that reads ``text`` and ends in a classifier."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def probabilities(self, df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
        # The model sees the text alone: columns of the input cannot meet those of its stages.
        source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).alias("text"))
        scored = self.model.transform(source)
        columns = [F.col("_row")[c].alias(c) for c in df.columns]
        return scored.select(*columns, evaluated_once(vector_to_array("probability")).alias(f"{name}_probs"))


class BatchScorer:
    """A user's model: ``load`` runs once per task and returns texts -> (rows, classes) scores.

    Arrow batches of the text column alone travel to Python; their size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.load = load

    def probabilities(self, df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(list(np.asarray(model(texts.tolist()), dtype=float)), index=texts.index)

        return df.withColumn(f"{name}_probs", run.asNondeterministic()(F.col(text_col)))


def score(
    df: DataFrame, scorers: Mapping[str, Scorer], text_col: str = "text", classes: int = CLASSES
) -> DataFrame:
    """Add ``{name}_probs``, ``{name}_pred`` and ``{name}_conf`` per scorer, in one pass.

    A missing text is scored as an empty one. Input columns with these names give way.
    """
    names = {f"{name}_{kind}" for name in scorers for kind in ("probs", "pred", "conf")}
    kept = [c for c in df.columns if c not in names]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("_scored_text"))
    return _score(rows, scorers, classes).drop("_scored_text")


def _score(df: DataFrame, scorers: Mapping[str, Scorer], classes: int, text_col: str = "_scored_text") -> DataFrame:
    out = df
    for name, scorer in scorers.items():
        out = scorer.probabilities(out, name, text_col)
    added: dict[str, Column] = {}
    for name in scorers:
        items = [F.get(F.col(f"{name}_probs"), F.lit(i)) for i in range(classes)]
        added[f"{name}_pred"] = argmax(items)
        added[f"{name}_conf"] = F.greatest(*items)
    return out.withColumns(added)


def predict(df: DataFrame, scorers: Mapping[str, Scorer], text_col: str = "text") -> DataFrame:
    """Score with both models and decide: adds sentiment, label, confidence, model_used.

    Input columns called sentiment, confidence or model_used are overwritten; one
    called label stays as ``INPUT_LABEL`` and gets its name back in the export.
    """
    first, second = list(scorers)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_upload"), F.col(text_col).alias("text"))
    scored = decide(
        score(rows, scorers),
        (f"{first}_pred", f"{first}_conf"),
        (f"{second}_pred", f"{second}_conf"),
        (first, second),
    )
    own = [
        F.col("_upload")[f.name].alias(INPUT_LABEL if f.name == "label" else f.name, metadata=f.metadata)
        for f in df.schema.fields
        if f.name not in ("sentiment", "confidence", "model_used")
    ]
    return scored.select(*own, "sentiment", "label", "confidence", "model_used")


#: Where an upload's own ``label`` column waits beside the predicted one.
INPUT_LABEL = "_input_label"


def ensemble_join(first: DataFrame, second: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Put two score tables side by side by row id, for scores that were written apart."""
    return first.select(id_col, F.col("pred").alias("social_pred"), F.col("confidence").alias("social_conf")).join(
        second.select(id_col, F.col("pred").alias("reviews_pred"), F.col("confidence").alias("reviews_conf")), id_col
    )


def train_classifier(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    weights: Mapping[int, float] | None = None,
    features: int = 1 << 14,
    max_iter: int = 20,
) -> PipelineModel:
    """Multinomial text classifier with a weight per class in its loss.

    The rows are evaluated once, whatever joins they come from.
    """
    weights = CLASS_WEIGHTS if weights is None else weights
    weight = F.lit(1.0)
    for label, value in weights.items():
        weight = F.when(F.col(label_col) == label, F.lit(float(value))).otherwise(weight)
    rows = df.select(
        F.col(text_col).alias("text"),
        F.col(label_col).cast("double").alias("_label"),
        weight.alias("_weight"),
    ).dropna()
    words = [
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=SPACE_PATTERN),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
    ]
    # Fitting reads its rows several times; written, they are counts of words instead of joins and texts.
    counted = PipelineModel(stages=words).transform(rows).select("_tf", "_label", "_weight")
    learnt = [
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features",
            labelCol="_label",
            weightCol="_weight",
            family="multinomial",
            maxIter=max_iter,
            regParam=0.01,
        ),
    ]
    return PipelineModel(stages=[*words, *Pipeline(stages=learnt).fit(written(counted, "training")).stages])


def save_scorer(model: PipelineModel, models_dir: str, name: str, tuned: bool = True) -> str:
    """Store a scorer as the tuned or the base model of a name."""
    path = f"{models_dir}/{name}/{'tuned' if tuned else 'base'}"
    model.write().overwrite().save(path)
    return path


def load_scorer(spark: SparkSession, models_dir: str, name: str) -> PipelineScorer:
    """The tuned model of a name if there is one, else its base model."""
    for kind in ("tuned", "base"):
        path = f"{models_dir}/{name}/{kind}"
        if path_exists(spark, path):
            return PipelineScorer(PipelineModel.load(path))
    raise FileNotFoundError(f"no model stored for {name!r} in {models_dir}")
