"""The jobs one after the other, from a raw corpus to a drift report."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions.labels import recode_stars
from plumbline.operators.scoring import PipelineScorer, train_classifier
from plumbline.plans.jobs import drift_job, evaluate_model, prepare_corpus, score_upload, store_baselines
from plumbline.sources.corpora import read_split
from plumbline.sources.log import read_log
from plumbline.sources.results import latest_drift_report, read_upload

WORDS = {0: ["awful", "broken"], 1: ["okay", "average"], 2: ["great", "lovely"]}


def corpus(spark, n=600):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        stars = int(rng.integers(1, 6))
        mood = 0 if stars < 3 else (1 if stars == 3 else 2)
        filler = " ".join(["word"] * int(rng.integers(0, 20)))
        rows.append((f"{rng.choice(WORDS[mood])} item {i} {filler}", stars))
    return spark.createDataFrame(rows, "Text string, Score int")


def test_from_corpus_to_drift_report(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("splits", "eval", "base", "log", "results", "actions", "report")}
    counts = prepare_corpus(corpus(spark), "Text", recode_stars("Score"), paths["splits"], holdout=0.2)
    assert {r.split: r.n for r in counts.collect()} == {"train": 480, "val": 60, "test": 60}
    scorer = PipelineScorer(train_classifier(read_split(spark, paths["splits"], "train"), max_iter=15))
    scorers = {"social": scorer, "reviews": scorer}
    report = evaluate_model(spark, paths["splits"], scorer, "social", paths["eval"])
    assert {r.metric: r.value for r in report.where("class is null").collect()}["test_accuracy"] > 0.9
    for name in scorers:
        store_baselines(spark, paths["splits"], scorer, name, paths["base"])

    assert drift_job(spark, paths["log"], paths["base"], paths["report"], "2024-01-02 00:00:00") is None
    upload = tmp_path / "up.csv"
    lines = ["text,customer_id"] + [f"{'awful' if i % 3 else 'great'} thing {i},C{i}" for i in range(90)] + [",C90"]
    upload.write_text("\n".join(lines) + "\n")
    totals, actions = score_upload(
        read_upload(spark, str(upload)), scorers, paths["log"], paths["results"], paths["actions"], "2024-01-01 12:00:00"
    )
    first = totals.first()
    assert (first.negative, first.positive, first.total) == (60, 30, 90)
    assert actions.endswith("crm_action_list_percentage_6.67percent.csv")
    listed = spark.read.option("header", True).csv(actions)
    assert listed.count() == 6 and listed.columns == ["customer_id", "text", "sentiment", "confidence", "model_used"]
    assert spark.read.option("header", True).csv(paths["results"]).count() == 90
    assert read_log(spark, paths["log"]).count() == 90

    drift = drift_job(spark, paths["log"], paths["base"], paths["report"], "2024-01-02 00:00:00")
    got = {(r.model, r.signal): r for r in drift.collect()}
    assert got["social", "target"].status == "ALERT" and got["social", "target"].n == 90
    assert got["reviews", "data"].status == "no_predictions"
    assert got["ensemble", "target"].psi == got["social", "target"].psi
    assert latest_drift_report(spark, paths["report"]).count() == 9
    assert drift_job(spark, paths["log"], paths["base"], paths["report"], "2024-02-01 00:00:00") is None
    assert drift.where(F.col("window_hours") != 24).isEmpty()
