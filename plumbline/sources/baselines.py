"""Stored baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.semantic import SemanticBaseline
from plumbline.session import path_exists
from plumbline.sources.schemas import BASELINE

BASELINE_COUNTS = "model string, signal string, feature string, x double, category string, n long"


def save_baselines(baselines: DataFrame, path: str) -> None:
    """Store baselines; only the models and signals in the frame are replaced."""
    (
        baselines.select(*BASELINE.names)
        .repartition("model", "signal")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "signal")
        .parquet(path)
    )


def load_baselines(
    spark: SparkSession, path: str, models: Sequence[str] | None = None, signals: Sequence[str] | None = None
) -> DataFrame:
    """Stored baselines of the given models and signals; empty when there are none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], BASELINE)
    rows = spark.read.schema(BASELINE).parquet(path)
    if models is not None:
        rows = rows.where(F.col("model").isin(*models))
    if signals is not None:
        rows = rows.where(F.col("signal").isin(*signals))
    return rows.select(*BASELINE.names)


def add_training_counts(counts: DataFrame, path: str, batch: str) -> None:
    """Add the baseline counts of one training batch to the store; adding a batch again replaces it."""
    (
        counts.withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def load_training_counts(spark: SparkSession, path: str, batches: Sequence[str] | None = None) -> DataFrame:
    """The counts of all batches, or of some; their baselines are ``baselines_of_counts``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], BASELINE_COUNTS)
    rows = spark.read.schema(f"{BASELINE_COUNTS}, batch string").parquet(path)
    if batches is not None:
        rows = rows.where(F.col("batch").isin(*batches))
    return rows.drop("batch")


def save_semantic(baseline: SemanticBaseline, path: str, name: str) -> None:
    """Store the fitted projection and clusters with their expected shares."""
    baseline.model.write().overwrite().save(f"{path}/{name}/model")
    baseline.expected.write.mode("overwrite").parquet(f"{path}/{name}/expected")


def load_semantic(spark: SparkSession, path: str, name: str) -> SemanticBaseline | None:
    """The stored semantic baseline, or none."""
    if not path_exists(spark, f"{path}/{name}/expected"):
        return None
    model = PipelineModel.load(f"{path}/{name}/model")
    return SemanticBaseline(model, spark.read.parquet(f"{path}/{name}/expected"))
