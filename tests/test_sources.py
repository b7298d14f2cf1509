import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.drift import build_baselines, production_psi
from plumbline.operators.prepare import select_available, to_labelled, upload_text
from plumbline.operators.split import stratified_split
from plumbline.sources.baselines import load_baselines, save_baselines
from plumbline.sources.corpora import read_reviews_csv, read_social_csv, read_split, write_splits
from plumbline.sources.log import append_log, corrupt_lines, read_log
from plumbline.sources.results import (
    export_actions,
    export_results,
    latest_drift_report,
    read_upload,
    write_drift_report,
    write_evaluation,
    write_snapshot,
)
from test_drift import SCHEMA, make


def test_headerless_latin1_corpus(spark, tmp_path):
    path = tmp_path / "social.csv"
    path.write_bytes(
        '"0","1467","Mon Apr 06","NO_QUERY","ann","café said ""no""\nagain, twice"\n'
        '"4","1468","Mon Apr 06","NO_QUERY","bob","fine"\n'.encode("latin-1")
    )
    rows = read_social_csv(spark, str(path)).orderBy("ids").collect()
    assert [(r.target, r.ids, r.user, r.text) for r in rows] == [
        (0, 1467, "ann", 'café said "no"\nagain, twice'),
        (4, 1468, "bob", "fine"),
    ]


def test_reviews_corpus_drops_missing(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('Id,Text,Score\n1,"a, ""b""",5\n2,,3\n3,c,\n4,d,1\n')
    got = read_reviews_csv(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [('a, "b"', 5), ("d", 1)]
    assert to_labelled(got, "Text", "Score").columns == ["text", "label"]


@pytest.mark.parametrize("header, first", [("review", "This product is amazing!"), ("text", "x")])
def test_upload_text_column(spark, tmp_path, header, first):
    path = tmp_path / "up.csv"
    path.write_text(f"{header},customer_id\n{first},C1\n,C2\n")
    upload = read_upload(spark, str(path))
    assert [tuple(r) for r in upload.select("text", "customer_id").collect()] == [(first, "C1")]
    assert upload.columns[:2] == [header, "customer_id"]  # no column loses its name
    moved = spark.createDataFrame([("C1", "t")], "customer_id string, text string")
    assert upload_text(moved).columns == ["customer_id", "text"]
    assert select_available(moved, ["phone_number", "text"]).columns == ["text"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_splits_round_trip(spark, tmp_path, fmt):
    rows = [(i, f'line {i} "q"\nnext', i % 3) for i in range(300)]
    df = stratified_split(spark.createDataFrame(rows, "id long, text string, label int"), "id", "label", 0.2)
    counts = {r.split: r.n for r in write_splits(df, str(tmp_path / fmt), fmt).collect()}
    assert counts == {"train": 240, "val": 30, "test": 30}
    test = read_split(spark, str(tmp_path / fmt), "test", fmt)
    want = df.where(F.col("split") == "test").select("text", "label")
    assert test.exceptAll(want).isEmpty() and want.exceptAll(test).isEmpty()
    if fmt == "parquet":
        plan = test._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(split" in plan


SCORED = [("téxt", "positive", 2, 0.9, "social"), ("bad", "negative", 0, 0.8, "reviews")]
SCORED_SCHEMA = "text string, sentiment string, label int, confidence double, model_used string"


def test_log_round_trip_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_log(spark, path).isEmpty()
    df = spark.createDataFrame(SCORED, SCORED_SCHEMA)
    append_log(df, path, "2024-01-01 10:00:00")
    append_log(df, path, "2024-01-03 10:00:00")
    bad = tmp_path / "log" / "log_date=2024-01-03" / "part-bad.json"
    bad.write_text('{"timestamp": "2024-01-03T1\nnot json\n' + json.dumps({"text": "late", "label": 1}) + "\n")
    got = read_log(spark, path)
    assert got.count() == 5
    assert corrupt_lines(spark, path).count() == 2
    assert {r.text_length for r in got.where("text_length is not null").collect()} == {3, 4}
    recent = read_log(spark, path, since="2024-01-02 00:00:00")
    assert recent.count() == 2
    assert "PartitionFilters: [isnotnull(log_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_baselines_replace_only_their_models(spark, tmp_path):
    path = str(tmp_path / "base")
    assert load_baselines(spark, path).isEmpty()
    df = spark.createDataFrame(make(0), SCHEMA)
    save_baselines(build_baselines(df), path)
    before = load_baselines(spark, path, models=["reviews"]).collect()
    save_baselines(build_baselines(df.where("model_used = 'social'").limit(50)), path)
    assert sorted(load_baselines(spark, path, models=["reviews"]).collect()) == sorted(before)
    stored = load_baselines(spark, path, signals=["target"])
    assert {r.signal for r in stored.collect()} == {"target"}
    full = build_baselines(df)
    save_baselines(full, path)
    loaded = {(r.model, r.signal): r.psi for r in production_psi(df, load_baselines(spark, path)).collect()}
    assert all(abs(v) < 1e-12 for v in loaded.values()) and len(loaded) == 6


def test_reports_keep_history(spark, tmp_path):
    path = str(tmp_path / "report")
    assert latest_drift_report(spark, path) is None
    schema = "model string, signal string, psi double"
    write_drift_report(spark.createDataFrame([("social", "data", 0.1)], schema), path, "2024-01-01 00:00:00")
    write_drift_report(spark.createDataFrame([("social", "data", 0.2)], schema), path, "2024-01-02 00:00:00")
    assert [r.psi for r in latest_drift_report(spark, path).collect()] == [0.2]
    assert spark.read.parquet(path).count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame(SCORED, SCORED_SCHEMA).withColumn("row_id", F.monotonically_increasing_id())
    export_results(df, str(tmp_path / "master"))
    back = spark.read.option("header", True).csv(str(tmp_path / "master"))
    assert back.count() == 2 and "label" not in back.columns
    path = export_actions(df, str(tmp_path))
    assert path.endswith("crm_action_list_percentage_50.00percent.csv")
    assert [r.text for r in spark.read.option("header", True).csv(path).collect()] == ["bad"]
    assert export_actions(df.where("sentiment = 'positive'"), str(tmp_path)) is None


def test_evaluation_and_snapshot_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0), (1, 2)], "label int, pred int")
    write_evaluation(df, str(tmp_path / "eval"), "social")
    got = {r.metric: r.value for r in spark.read.parquet(str(tmp_path / "eval")).where("class is null").collect()}
    assert got["test_accuracy"] == 0.5
    metrics = spark.createDataFrame([("m", {"a": "b"}, 1.0)], "metric string, labels map<string,string>, value double")
    write_snapshot(metrics, str(tmp_path / "snap"), "2024-01-01 00:00:00")
    assert spark.read.parquet(str(tmp_path / "snap")).first().labels == {"a": "b"}
