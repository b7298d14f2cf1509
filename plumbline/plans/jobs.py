"""The jobs end to end: prepare, score, evaluate, baselines, drift.

Each job reads stored tables, writes its result and returns what it reports.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import content_key
from plumbline.functions.labels import MODELS
from plumbline.operators.drift import FALLBACK_HOURS, SIGNALS, WINDOW_HOURS, Signal, build_baselines, drift_summary
from plumbline.operators.metrics import sentiment_counts
from plumbline.operators.prepare import drop_missing, to_labelled
from plumbline.operators.scoring import Scorer, predict, score
from plumbline.operators.semantic import SemanticBaseline, assign_clusters, fit_semantic, model_baselines, semantic_drift_job
from plumbline.operators.split import numbered_copies, stratified_split
from plumbline.plans.small import lookup_join, written
from plumbline.sources.baselines import load_baselines, load_semantic, save_baselines, save_semantic
from plumbline.sources.corpora import read_split, write_splits
from plumbline.sources.embeddings import add_embeddings, embeddings_of
from plumbline.sources.log import append_log, read_log
from plumbline.sources.results import export_actions, export_results, write_drift_report, write_evaluation


def prepare_corpus(
    raw: DataFrame,
    text_col: str,
    label: Column,
    path: str,
    holdout: float = 0.01,
    test_share: float = 0.5,
    seed: int = 42,
    stratify: bool = True,
) -> DataFrame:
    """Recode, split and store a raw corpus; returns the rows per split.

    Raw rows carry no id, so the labelled rows are written once with one made of
    their content: the same corpus gives the same split in whatever files it comes.
    """
    labelled = drop_missing(to_labelled(raw, text_col, label), ["label"])
    numbered = written(numbered_copies(labelled, ["text", "label"]), "corpus")
    split = stratified_split(numbered, "_id", "label" if stratify else None, holdout, test_share, seed)
    return write_splits(split.drop("_id"), path)


def score_upload(
    upload: DataFrame,
    scorers: Mapping[str, Scorer],
    log_path: str,
    results_path: str,
    actions_folder: str,
    batch_ts: str,
) -> tuple[DataFrame, str | None]:
    """Score an upload once and feed the result file, the log and the action list.

    Returns the sentiment counts and the path of the action list, if there is one.
    """
    scored = written(
        predict(upload, scorers).withColumn("row_id", F.monotonically_increasing_id()), "scored"
    )
    export_results(scored.drop("row_id"), results_path)
    append_log(scored, log_path, batch_ts)
    actions = export_actions(scored, actions_folder)
    return sentiment_counts(scored), actions


def evaluate_model(
    spark: SparkSession, splits_path: str, scorer: Scorer, name: str, report_path: str
) -> DataFrame:
    """Score the stored test split and append the evaluation report."""
    test = score(read_split(spark, splits_path, "test"), {name: scorer})
    return write_evaluation(test, report_path, name, "label", f"{name}_pred")


def store_baselines(
    spark: SparkSession, splits_path: str, scorer: Scorer, name: str, path: str, signals: Sequence[Signal] = SIGNALS
) -> DataFrame:
    """Baselines of one model: lengths and labels of its training rows, confidences on its validation rows."""
    train = read_split(spark, splits_path, "train")
    rows = train.select(
        F.lit(name).alias("model_used"),
        F.length("text").alias("text_length"),
        "label",
        F.lit(None).cast("double").alias("confidence"),
    )
    validation = score(read_split(spark, splits_path, "val").where(F.col("text").isNotNull()), {name: scorer})
    confidences = validation.select(
        F.lit(name).alias("model_used"),
        F.lit(None).cast("int").alias("text_length"),
        F.lit(None).cast("int").alias("label"),
        F.col(f"{name}_conf").alias("confidence"),
    )
    baselines = build_baselines(written(rows.unionByName(confidences), "training"), signals)
    save_baselines(baselines, path)
    return baselines


NO_PREDICTIONS = "no_predictions"
REPORT = "model string, signal string, psi double, level string, risk_pct double, status string, n long"


def hours_before(spark: SparkSession, now: str, hours: int) -> str:
    """The UTC time ``hours`` before ``now``."""
    return spark.sql(f"select cast(timestamp '{now}' - interval {int(hours)} hours as string) as t").first().t


def drift_job(
    spark: SparkSession,
    log_path: str,
    baselines_path: str,
    report_path: str,
    now: str,
    hours: int = WINDOW_HOURS,
    models: Sequence[str] = MODELS,
    say_why: bool = False,
) -> DataFrame | None:
    """Score the last ``hours`` before ``now`` against the baselines.

    The report states its window and how many predictions that holds. Without any there is nothing to
    report; with ``say_why`` that itself is reported, as one row of status ``no_predictions``.
    """
    window = read_log(spark, log_path, hours_before(spark, now, hours))
    if not window.isEmpty():
        summary = drift_summary(window, load_baselines(spark, baselines_path), models=models)
    elif say_why:
        summary = spark.createDataFrame([("ensemble", "all", None, "unknown", 0.0, NO_PREDICTIONS, 0)], REPORT)
    else:
        return None
    total = F.max(F.when(F.col("model") == "ensemble", F.col("n"))).over(Window.partitionBy())
    report = written(summary.withColumns({"window_hours": F.lit(hours), "total_predictions": total}), "report")
    write_drift_report(report, report_path, now)
    return report


Encode = Callable[[DataFrame], DataFrame]  # adds an ``embedding`` array to rows with a ``text``


def store_semantic_baseline(
    spark: SparkSession, splits_path: str, encode: Encode, name: str, path: str
) -> SemanticBaseline:
    """Projection, clusters and expected shares of one model's training texts, all of them."""
    train = read_split(spark, splits_path, "train").where(F.col("text").isNotNull())
    baseline = fit_semantic(encode(train), "text")
    save_semantic(baseline, path, name)
    return baseline


def stored_clusters(
    rows: DataFrame, baseline: SemanticBaseline, store: str, name: str, encode: Encode, batch: str
) -> DataFrame:
    """``ts, model_used, cluster`` of log rows: every distinct text is encoded and assigned once.

    Rows meet their cluster by content key; a text that makes up a large share of them is spread.
    """
    add_embeddings(rows, store, name, encode, batch)
    keyed = written(rows.select("ts", "model_used", content_key("text").alias("content_key")), "log-keys")
    vectors = embeddings_of(keyed, store, name)
    clusters = written(assign_clusters(vectors, baseline.model).select("content_key", "cluster"), "key-clusters")
    found = lookup_join(keyed, clusters, "content_key", spread=F.monotonically_increasing_id())
    return found.select("ts", "model_used", "cluster")


def semantic_drift_run(
    spark: SparkSession,
    log_path: str,
    baselines_path: str,
    encoders: Mapping[str, Encode],
    report_path: str,
    now: str,
    store: str | None = None,
    **options,
) -> DataFrame:
    """Meaning drift of every model against its own stored baseline.

    Each model's rows pass its encoder and its clusters. A model without a stored baseline is
    reported as such, and too few rows as too few. ``options`` go to ``semantic_drift_job``.

    Of the log only the longer window before ``now`` is read. With ``store``, a folder of embeddings
    by content, only texts that it lacks are encoded, once each, and are added to it.
    """
    end = F.lit(now).cast("timestamp")
    longest = max(options.get("hours", WINDOW_HOURS), options.get("fallback", FALLBACK_HOURS))
    log = read_log(spark, log_path, hours_before(spark, now, longest)).withColumnRenamed("timestamp", "ts")
    parts, expected = [], []
    for name, encode in encoders.items():
        mine = log.where((F.col("model_used") == name) & (F.col("ts") <= end))
        baseline = load_semantic(spark, baselines_path, name)
        if baseline is None:
            mine = mine.withColumn("cluster", F.lit(None).cast("int"))
        else:
            mine = mine.where(F.col("text").isNotNull())
            if store is None:
                mine = assign_clusters(encode(mine), baseline.model)
            else:
                mine = stored_clusters(mine, baseline, store, name, encode, now)
            expected.append(baseline.expected.withColumn("model_used", F.lit(name)))
        parts.append(mine.select("ts", "model_used", "cluster"))
    clustered = written(reduce(lambda a, b: a.unionByName(b), parts), "clustered")
    none = "model string, signal string, feature string, kind string, bin int, lo double, hi double, category string, expected double"
    baselines = reduce(lambda a, b: a.unionByName(b), map(model_baselines, expected)) if expected else spark.createDataFrame([], none)
    report = semantic_drift_job(clustered, baselines, tuple(encoders), now=end, **options)
    report = written(report, "semantic-report")
    write_drift_report(report, report_path, now)
    return report
