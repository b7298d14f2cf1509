"""Embedding store, published versions, ids from content, reports of empty windows."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions.labels import recode_stars
from plumbline.operators.scoring import train_classifier
from plumbline.operators.semantic import fit_semantic
from plumbline.operators.split import numbered_copies
from plumbline.plans.jobs import drift_job, prepare_corpus, semantic_drift_run, store_semantic_baseline
from plumbline.sources.embeddings import add_embeddings, embeddings_of, load_embeddings
from plumbline.sources.log import append_log, read_log
from plumbline.sources.models import (
    publish,
    publish_scorer,
    publish_semantic,
    published_scorer,
    published_semantic,
    resolve,
    versions,
)
from plumbline.sources.results import latest_drift_report, latest_drift_run, write_drift_report

def plain_encode(df):
    return df.withColumn("embedding", F.array(F.length("text").cast("double"), F.ascii("text").cast("double")))


def counting(spark):
    """An encoder and the number of rows it was given."""
    seen = spark.sparkContext.accumulator(0)

    def encode(df):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                batch["embedding"] = [[float(len(t)), float(ord(t[0]) if t else 0)] for t in batch["text"]]
                yield batch

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{fields}, embedding array<double>")

    return encode, seen


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_a_text_is_encoded_once(spark, tmp_path):
    path = str(tmp_path / "store")
    encode, seen = counting(spark)
    add_embeddings(texts(spark, "a", "a", "bb", None, ""), path, "e", encode, "2024-05-01 10:00:00")
    assert seen.value == 3
    second = texts(spark, "bb", "ccc", "ccc", "a")
    add_embeddings(second, path, "e", encode, "2024-05-02 10:00:00")
    assert seen.value == 4
    add_embeddings(second, path, "e", encode, "2024-05-02 10:00:00")  # again: replaces itself
    assert seen.value == 5 and load_embeddings(spark, path, "e").count() == 4
    add_embeddings(texts(spark, "a", "bb"), path, "e", encode, "2024-05-03 10:00:00")  # nothing new
    assert seen.value == 5
    add_embeddings(texts(spark, "a"), path, "other", encode, "2024-05-03 10:00:00")
    assert seen.value == 6
    keys = texts(spark, "a", "a", "ccc", "unknown", None).select(F.sha2("text", 256).alias("content_key"))
    assert sorted(r["embedding"][0] for r in embeddings_of(keys, path, "e").collect()) == [1.0, 3.0]
    assert load_embeddings(spark, str(tmp_path / "none"), "e").count() == 0
    empty = texts(spark, "a").where("false")
    add_embeddings(empty, path, "e", encode, "2024-05-04 10:00:00")
    assert load_embeddings(spark, path, "e").count() == 4


def test_texts_from_a_table_of_their_own(spark, tmp_path):
    """Rows carry keys; of the table each text that they name is encoded once, copies and all."""
    path = str(tmp_path / "store")
    encode, seen = counting(spark)
    table = texts(spark, "a", "a", "bb", "ccc", None, "", "unused").withColumn("content_key", F.sha2("text", 256))
    keys = lambda *values: texts(spark, *values).select(F.sha2("text", 256).alias("content_key"))
    add_embeddings(keys("a", "a", "bb", None, ""), path, "e", encode, "2024-05-01 10:00:00", texts=table)
    assert seen.value == 3
    for _ in range(2):  # again: replaces itself
        add_embeddings(keys("bb", "ccc", "a", "gone"), path, "e", encode, "2024-05-02 10:00:00", texts=table)
    assert seen.value == 5
    stored = {(r.batch[8:10], r.embedding[0]) for r in load_embeddings(spark, path, "e").collect()}
    assert stored == {("01", 1.0), ("01", 2.0), ("01", 0.0), ("02", 3.0)}


def test_no_sort_of_copies_before_encoding(spark, tmp_path):
    plans = []

    def encode(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.select("content_key", F.array(F.length("text").cast("double")).alias("embedding"))

    add_embeddings(texts(spark, "a", "a"), str(tmp_path / "store"), "e", encode, "2024-05-01 10:00:00")
    assert "SortAggregate" not in plans[0] and "HashAggregate" in plans[0]


def log_rows(spark, n, model="social", word="a"):
    return spark.createDataFrame(
        [(word * (1 + i % 9), "neutral", 1, 0.5, model) for i in range(n)],
        "text string, sentiment string, label int, confidence double, model_used string",
    )


def test_semantic_run_encodes_new_texts_of_the_window_only(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("splits", "base", "log", "store", "plain", "stored")}
    train = [("a" * (1 + i % 9), i % 3, "train") for i in range(300)]
    spark.createDataFrame(train, "text string, label int, split string").write.partitionBy("split").parquet(at["splits"])
    store_semantic_baseline(spark, at["splits"], plain_encode, "social", at["base"])
    append_log(log_rows(spark, 40, word="z"), at["log"], "2024-03-01 10:00:00")  # long before the window
    append_log(log_rows(spark, 600), at["log"], "2024-05-01 10:00:00")
    append_log(log_rows(spark, 600, word="b"), at["log"], "2024-05-01 22:00:00")  # after ``now`` of the first run
    encode, seen = counting(spark)
    run = lambda now, report, store: {
        r["model"]: r for r in semantic_drift_run(spark, at["log"], at["base"], {"social": encode}, report, now, store=store).collect()
    }
    first = run("2024-05-01 20:00:00", at["stored"], at["store"])
    assert seen.value == 9 and first["social"]["n"] == 600 and first["social"]["psi"] < 0.01
    second = run("2024-05-02 08:00:00", at["stored"], at["store"])
    assert seen.value == 18 and second["social"]["n"] == 1200
    run("2024-05-02 09:00:00", at["stored"], at["store"])
    assert seen.value == 18
    plain = run("2024-05-02 08:00:00", at["plain"], None)
    assert plain == second


def test_versions_are_found_only_when_whole(spark, tmp_path):
    root = str(tmp_path / "models")
    assert versions(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        resolve(spark, root, "social")
    df = spark.createDataFrame([("good good", 2), ("bad bad", 0), ("so so", 1)] * 4, "text string, label int")
    model = train_classifier(df, max_iter=3)
    assert publish_scorer(spark, model, root, "social_small", "base") == 1
    assert publish_scorer(spark, model, root, "social_small", "tuned", note="x") == 2
    assert publish_scorer(spark, model, root, "social_small", "base") == 3
    # Half written: data without a manifest, and a manifest under its temporary name.
    model.write().save(f"{root}/social_small/data/tuned-half")
    (tmp_path / "models/social_small/versions/_part").write_text('{"name": "social_small", "kind": "tuned", "version": 9, "path": "x"}')

    def dies(path):
        (tmp_path / "models/social_small/data/dying").mkdir()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publish(spark, root, "social_small", dies)
    assert versions(spark, root).count() == 3
    found = resolve(spark, root, "social")
    assert (found["name"], found["kind"], found["version"], found["note"]) == ("social_small", "tuned", 2, "x")
    assert resolve(spark, root, "social", version=1)["kind"] == "base"
    assert resolve(spark, root, "social_small", kind="base")["version"] == 3
    for missing in ("soc", "social_small_", "socialXsmall"):
        with pytest.raises(FileNotFoundError):
            resolve(spark, root, missing)
    publish(spark, root, "social", lambda path: model.write().save(path), "base")
    assert resolve(spark, root, "social")["name"] == "social"  # the name itself goes before a prefix
    assert published_scorer(spark, root, "social_small", 2) is not None
    with pytest.raises(ValueError):
        publish(spark, root, "social", lambda path: None, "best")


def test_a_taken_number_is_not_overwritten(spark, tmp_path):
    root = str(tmp_path / "models")
    publish(spark, root, "m", lambda path: None)

    def rival(path):
        """Another job publishes while this one writes."""
        (tmp_path / "models/m/versions/00000002.json").write_text(
            json.dumps({"name": "m", "kind": "base", "version": 2, "path": "theirs", "note": ""})
        )

    assert publish(spark, root, "m", rival) == 3
    assert {r["version"]: r["path"] == "theirs" for r in versions(spark, root).collect()} == {1: False, 2: True, 3: False}


def test_semantic_baselines_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "baselines")
    vectors = spark.range(200).select("id", F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(3)]).alias("embedding"))
    baseline = fit_semantic(vectors, "id", clusters=3)
    assert publish_semantic(spark, baseline, root, "social") == 1
    got = published_semantic(spark, root, "social")
    assert sorted(map(tuple, got.expected.collect())) == sorted(map(tuple, baseline.expected.collect()))


def test_ids_of_copies_do_not_depend_on_layout(spark):
    rows = [("x", 1)] * 57 + [("x", 2)] * 3 + [("y", None), (None, 1), (None, 1), ("", 0)]
    want = Counter(rows)
    made = []
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "text string, label int").repartition(parts)
        got = numbered_copies(df, ["text", "label"], copies=10).collect()
        assert Counter((r["text"], r["label"]) for r in got) == want
        assert len({r["_id"] for r in got}) == len(rows)
        made.append(sorted((r["_id"], str(r["text"]), str(r["label"])) for r in got))
    assert made[0] == made[1]
    clash = numbered_copies(spark.createDataFrame([(1, 2)] * 3, "_n int, _block int"), ["_n", "_block"], copies=2)
    assert clash.count() == 3 and clash.columns == ["_n", "_block", "_id"]
    assert numbered_copies(df.where("false"), ["text", "label"]).count() == 0


def test_same_split_from_any_layout(spark, tmp_path):
    rows = [(f"text {i % 90}", 1 + i % 5) for i in range(400)] + [("copy", 5)] * 200
    raw = spark.createDataFrame(rows, "Text string, Score int")
    found = []
    for parts in (1, 8):
        path = str(tmp_path / f"s{parts}")
        prepare_corpus(raw.repartition(parts), "Text", recode_stars("Score"), path, holdout=0.2)
        found.append(Counter(map(tuple, spark.read.parquet(path).select("text", "label", "split").collect())))
    assert found[0] == found[1] and sum(found[0].values()) == 600
    assert {s for (t, _, s) in found[0] if t == "copy"} == {"train", "val", "test"}


def test_an_empty_window_is_reported_when_asked(spark, tmp_path):
    log, base, report = (str(tmp_path / k) for k in ("log", "base", "report"))
    old = spark.createDataFrame([("social", "data", 0.3, "high", 50.0, "ALERT", 7, 24)],
                                "model string, signal string, psi double, level string, risk_pct double, status string, n long, window_hours int")
    write_drift_report(old, report, "2024-01-01 00:00:00")  # a report without the newer columns
    assert drift_job(spark, log, base, report, "2024-01-02 00:00:00") is None
    got = drift_job(spark, log, base, report, "2024-01-03 00:00:00", say_why=True).collect()
    assert [(r["status"], r["n"], r["window_hours"], r["total_predictions"]) for r in got] == [("no_predictions", 0, 24, 0)]
    assert latest_drift_report(spark, report).count() == 2
    newest = latest_drift_run(spark, report).collect()
    assert [r["status"] for r in newest] == ["no_predictions"]
    append_log(log_rows(spark, 30), log, "2024-01-03 12:00:00")
    assert read_log(spark, log).count() == 30
    later = drift_job(spark, log, base, report, "2024-01-04 00:00:00", say_why=True)
    assert {(r["total_predictions"], r["window_hours"]) for r in later.collect()} == {(30, 24)}
    assert latest_drift_run(spark, report).count() == later.count()
    assert latest_drift_run(spark, str(tmp_path / "none")) is None
