"""Cases that the given tables do not show: odd times, undated logs, colliding uploads, missing values."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import semantic
from plumbline.operators.lifecycle import anchored_windows
from plumbline.operators.prepare import with_text
from plumbline.operators.scoring import PipelineScorer, predict, score, train_classifier
from plumbline.operators.semantic import fit_semantic, nearest_centroid
from plumbline.plans.jobs import semantic_drift_run, store_semantic_baseline
from plumbline.sources.log import read_log
from plumbline.sources.results import export_results
from plumbline.streaming.queries import lifecycle_stream, read_files, run_available

LOG = "ts timestamp, sentiment string, tenant string"


def test_rotation_counts_elapsed_time(spark):
    rows = [(datetime(2024, 1, 1, 18), "positive", "a"), (datetime(2024, 4, 1, 9), "negative", "a"), (datetime(2024, 4, 1, 18), "neutral", "a")]
    df = spark.createDataFrame(rows, LOG)
    one = anchored_windows(df.limit(2)).collect()
    assert len(one) == 1 and one[0]["start_date"] == rows[0][0] and one[0]["end_date"] is None and one[0]["total"] == 2
    both = sorted(anchored_windows(df, by=["tenant"]).collect(), key=lambda r: r["start_date"])
    assert [(r["start_date"], r["end_date"], r["total"]) for r in both] == [(rows[0][0], rows[2][0], 2), (rows[2][0], None, 1)]


def test_rotation_of_many_tenants_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    start = datetime(2023, 1, 1)
    rows = [(start + timedelta(seconds=int(s)), "positive", f"t{k}") for s, k in zip(rng.integers(0, 4e7, 3000), rng.integers(0, 7, 3000))]
    rows += [(r[0], "neutral", None) for r in rows[:300]]
    want = {}
    for tenant in {r[2] for r in rows}:
        opened = None
        for t in sorted(r[0] for r in rows if r[2] == tenant):
            if opened is None or t - opened >= timedelta(days=30):
                opened = t
            want[tenant, opened] = want.get((tenant, opened), 0) + 1
    got = anchored_windows(spark.createDataFrame(rows, LOG), by=["tenant"], days=30).collect()
    assert {(r["tenant"], r["start_date"]): r["total"] for r in got} == want


def test_stream_rotation_counts_elapsed_time(spark, tmp_path):
    first = [(datetime(2024, 1, 1, 18), "positive", "a"), (datetime(2024, 4, 1, 9), "negative", "a")]
    second = [(datetime(2024, 4, 2, 18), "neutral", "a"), (datetime(2024, 9, 1), "neutral", "a")]
    for rows in (first, second):
        spark.createDataFrame(rows, LOG).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lifecycle_stream(read_files(spark, str(tmp_path / "in"), LOG))
    run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start_date").first()
    assert (got["start_date"], got["end_date"], got["total"]) == (first[0][0], second[0][0], 2)


def test_dated_read_of_an_undated_log(spark, tmp_path):
    lines = [f'{{"timestamp": "2024-05-0{d} 10:00:00", "text": "x", "sentiment": "neutral"}}' for d in range(1, 6)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part.json").write_text("\n".join(lines))
    assert read_log(spark, str(tmp_path / "log")).count() == 5
    assert read_log(spark, str(tmp_path / "log"), since="2024-05-03 00:00:00").count() == 3


@pytest.fixture(scope="module")
def scorers(spark):
    texts = [("good movie fine", 2), ("bad awful film", 0), ("plain film", 1)] * 4
    model = train_classifier(spark.createDataFrame(texts, "text string, label int"), features=64, max_iter=3)
    return {"social": PipelineScorer(model), "reviews": PipelineScorer(model)}


def test_uploads_keep_their_own_columns(spark, tmp_path, scorers):
    rows = [("good movie", "mine", "0.1", "A", "k"), ("bad film", None, "x", "B", "l")]
    upload = spark.createDataFrame(rows, "review string, label string, confidence string, social_pred string, probability string")
    export_results(predict(with_text(upload), scorers), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted(["review", "label", "social_pred", "probability", "sentiment", "confidence", "model_used"])
    assert {(r["review"], r["label"], r["social_pred"]) for r in back.collect()} == {("good movie", "mine", "A"), ("bad film", None, "B")}
    own = spark.createDataFrame([("q", "good movie")], "id string, text string")
    assert "text" in predict(with_text(own), scorers).columns


def test_missing_texts_are_scored_as_empty(spark, scorers):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "good movie")], "k int, text string")
    got = {r["k"]: r["social_pred"] for r in score(df, {"social": scorers["social"]}).collect()}
    assert got[1] == got[2] and None not in got.values()


def test_vectors_may_be_missing_and_centroids_many(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points, centres = rng.normal(size=(200, 4)), rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(999, None)], "id int, embedding array<double>")
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centroid array<double>")
    want = {i: int(((points[i] - centres) ** 2).sum(axis=1).argmin()) for i in range(200)} | {999: None}
    assert {r["id"]: r["cluster"] for r in nearest_centroid(df, centroids).collect()} == want
    monkeypatch.setattr(semantic, "CENTROID_NUMBERS", 40)
    assert {r["id"]: r["cluster"] for r in nearest_centroid(df, centroids).collect()} == want


def test_shares_cover_more_rows_than_a_sample(spark):
    df = spark.range(12_000).select("id", F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(3)]).alias("embedding"))
    assert fit_semantic(df, "id", clusters=3).expected.agg(F.sum("n")).first()[0] == 12_000
    assert fit_semantic(df, "id", clusters=3, max_rows=100).expected.agg(F.sum("n")).first()[0] == 12_000


def test_semantic_drift_from_stored_baselines(spark, tmp_path):
    def encode(df):
        return df.withColumn("embedding", F.array(F.length("text").cast("double"), F.ascii("text").cast("double")))

    train = [("a" * (1 + i % 9), i % 3, "train") for i in range(300)]
    spark.createDataFrame(train, "text string, label int, split string").write.partitionBy("split").parquet(str(tmp_path / "splits"))
    store_semantic_baseline(spark, str(tmp_path / "splits"), encode, "social", str(tmp_path / "base"))
    log = [f'{{"timestamp": "2024-05-01 1{i % 3}:00:00", "text": "{"a" * (1 + i % 9)}", "sentiment": "neutral", "label": 1, "confidence": 0.5, "model_used": "{m}"}}'
           for i in range(300) for m in ("social", "reviews")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part.json").write_text("\n".join(log))
    encoders = {"social": encode, "reviews": encode}
    report = semantic_drift_run(spark, str(tmp_path / "log"), str(tmp_path / "base"), encoders, str(tmp_path / "report"), "2024-05-01 20:00:00")
    got = {r["model"]: r for r in report.collect()}
    assert got["social"]["psi"] < 0.01 and got["social"]["status"] == "OK"
    assert got["reviews"]["status"] == "no_baseline" and got["ensemble"]["psi"] == got["social"]["psi"]
