"""Uploads in; results, action lists and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.actions import action_list, action_share
from plumbline.operators.evaluate import evaluation_report
from plumbline.operators.prepare import with_text
from plumbline.operators.scoring import INPUT_LABEL
from plumbline.plans.small import written
from plumbline.session import path_exists


def read_upload(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """An uploaded CSV with a ``text`` column; all columns pass through.

    ``multi_line=False`` lets a file without line breaks in its fields be read in parallel.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )
    return with_text(raw)


def export_results(df: DataFrame, path: str) -> None:
    """The input columns with sentiment, confidence and model_used, as CSV."""
    exported(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def exported(df: DataFrame) -> DataFrame:
    """Scored rows under the upload's own columns: no copy of the text, its own label back."""
    copy = "text" in df.columns and "copy_of" in df.schema["text"].metadata
    out = df.drop("label", *(["text"] if copy else []))
    return out.withColumnRenamed(INPUT_LABEL, "label")


def export_actions(df: DataFrame, folder: str, id_col: str = "row_id") -> str | None:
    """The action list as one CSV whose name tells its share of the input; none without negatives.

    The list is capped by definition, so one file is right.
    """
    listed = written(action_list(df, id_col), "actions")
    share = action_share(listed, df.count())
    if share == 0.0 and listed.isEmpty():
        return None
    path = f"{folder}/crm_action_list_percentage_{share:.2f}percent.csv"
    listed.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_evaluation(df: DataFrame, path: str, model: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Append the evaluation of one model to the long report table."""
    report = evaluation_report(df, label, pred).withColumn("model", F.lit(model))
    report.write.mode("append").parquet(path)
    return report


def write_drift_report(report: DataFrame, path: str, run_ts: str) -> None:
    """Append a report to the history, partitioned by the date of the run."""
    stamped = report.withColumn("run_ts", F.lit(run_ts).cast("timestamp"))
    (
        stamped.withColumn("run_date", F.to_date("run_ts"))
        .write.mode("append")
        .partitionBy("run_date")
        .parquet(path)
    )


def latest_drift_report(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest row per model and signal, or nothing before the first run."""
    if not path_exists(spark, path):
        return None
    history = spark.read.option("mergeSchema", True).parquet(path).drop("run_date")
    columns = [c for c in history.columns if c not in ("model", "signal")]
    newest = F.max_by(F.struct(*columns), "run_ts").alias("r")
    return history.groupBy("model", "signal").agg(newest).select("model", "signal", "r.*")


def latest_drift_run(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the newest run, or nothing before the first; of the history only its last date is read."""
    if not path_exists(spark, path):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    dates = [f.getPath().getName() for f in listed if f.getPath().getName().startswith("run_date=")]
    if not dates:
        return None
    last = spark.read.option("mergeSchema", True).parquet(f"{path}/{max(dates)}")
    return last.where(F.col("run_ts") == last.agg(F.max("run_ts")).scalar())


def write_snapshot(metrics: DataFrame, path: str, run_ts: str) -> None:
    """Append a metrics snapshot with the time it was taken."""
    stamped = metrics.withColumn("ts", F.lit(run_ts).cast("timestamp"))
    stamped.write.mode("append").parquet(path)
