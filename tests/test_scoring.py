import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

import plumbline.registry.scoring as registered
from plumbline.operators.actions import action_list, action_rows, action_share
from plumbline.operators.cache import cache_hit, cache_miss, with_key
from plumbline.operators.evaluate import confusion_matrix, evaluate_overall, evaluate_per_class
from plumbline.operators.scoring import (
    BatchScorer,
    PipelineScorer,
    ensemble_join,
    load_scorer,
    predict,
    save_scorer,
    score,
    train_classifier,
)

TEXTS = [("good movie", 2), ("bad movie", 0), ("ok film", 1), ("great", 2), ("terrible", 0)] * 8


@pytest.mark.parametrize("negatives, kept", [(0, 0), (1, 1), (11, 2), (20_000, 1000)])
def test_action_list_size(spark, negatives, kept):
    rows = spark.range(negatives + 5).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") < negatives, "negative").otherwise("positive").alias("sentiment"),
        (F.col("id") % 7 / 10.0).alias("confidence"),
        F.lit("social").alias("model_used"),
        F.lit("c").alias("customer_id"),
    )
    got = action_rows(rows).orderBy("rank").collect()
    assert len(got) == kept
    want = sorted(((-(i % 7 / 10.0), i) for i in range(negatives)))[:kept]
    assert [r.row_id for r in got] == [i for _, i in want]
    assert action_list(rows).columns == ["customer_id", "sentiment", "confidence", "model_used"]
    assert action_share(action_list(rows), negatives + 5) == round(100 * kept / (negatives + 5), 2)


def test_batch_scorers_and_decision(spark):
    def keywords():
        def run(texts):
            known = {"bad": [0.8, 0.1, 0.1], "great": [0.05, 0.05, 0.9]}
            return np.array([known.get(t.split()[0], [0.2, 0.6, 0.2]) for t in texts])

        return run

    def cheerful():
        return lambda texts: np.tile([0.1, 0.2, 0.7], (len(texts), 1))

    df = spark.createDataFrame([("bad day",), ("great day",), ("day",)], "text string")
    out = predict(df, {"social": BatchScorer(keywords), "reviews": BatchScorer(cheerful)})
    got = {r.text: (r.label, r.confidence, r.model_used) for r in out.collect()}
    assert got == {
        "bad day": (0, 0.8, "social"),
        "great day": (2, 0.9, "social"),
        "day": (1, 0.6, "social"),
    }


def test_training_learns_and_models_are_found(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "text string, label int")
    model = train_classifier(df, max_iter=30)
    out = score(df, {"m": PipelineScorer(model)})
    assert out.where(F.col("m_pred") != F.col("label")).isEmpty()
    assert all(abs(sum(r.m_probs) - 1) < 1e-9 for r in out.collect())
    save_scorer(model, str(tmp_path), "social", tuned=False)
    base = load_scorer(spark, str(tmp_path), "social")
    heavy = train_classifier(df, weights={0: 50.0}, max_iter=30)
    save_scorer(heavy, str(tmp_path), "social", tuned=True)
    tuned = load_scorer(spark, str(tmp_path), "social")
    unseen = spark.createDataFrame([("unseen words",)], "text string")
    p_base = base.probabilities(unseen, "m").first().m_probs[0]
    p_tuned = tuned.probabilities(unseen, "m").first().m_probs[0]
    assert p_tuned > p_base
    with pytest.raises(FileNotFoundError):
        load_scorer(spark, str(tmp_path), "reviews")


def test_ensemble_join(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.6)], "row_id long, pred int, confidence double")
    b = spark.createDataFrame([(2, 2, 0.7), (1, 0, 0.9)], "row_id long, pred int, confidence double")
    got = ensemble_join(a, b).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.5, 0, 0.9), (2, 1, 0.6, 2, 0.7)]


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (2, 1)], "label int, pred int")
    got = {r["class"]: (r.precision, r.recall) for r in evaluate_per_class(confusion_matrix(df)).collect()}
    assert got == {0: (0.5, 1.0), 1: (0.5, 1.0), 2: (0.0, 0.0)}


def test_overall_equals_spark_evaluator(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in zip(rng.integers(0, 3, 400), rng.integers(0, 3, 400))]
    df = spark.createDataFrame(rows, "label double, pred double")
    got = {r.metric: r.value for r in evaluate_overall(confusion_matrix(df)).collect()}
    for metric, name in (("test_accuracy", "accuracy"), ("test_f1", "f1")):
        want = MulticlassClassificationEvaluator(labelCol="label", predictionCol="pred", metricName=name).evaluate(df)
        assert got[metric] == pytest.approx(want, abs=1e-12)


def test_cache_with_a_hot_text(spark):
    rows = [(i, "same words" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    scored = with_key(spark.createDataFrame([("same words", 7), ("text 1", 1), ("other", 3)], "text string, mark int"))
    hits = cache_hit(df, scored.select("content_key", "mark"), "id").collect()
    want = {i: (7 if t == "same words" else 1) for i, t in rows if t in ("same words", "text 1")}
    assert {r.id: r.mark for r in hits} == want and len(hits) == len(want)
    misses = cache_miss(df, scored, "id").collect()
    assert {r.text for r in misses} == {t for _, t in rows} - {"same words", "text 1"}
    assert len(misses) == len({r.text for r in misses})


def test_filter_on_the_outcome_does_not_repeat_the_model(spark):
    df = spark.createDataFrame(TEXTS, "text string, label int")
    model = PipelineScorer(train_classifier(df, max_iter=5))
    kept = predict(df, {"social": model, "reviews": model}).where("sentiment = 'negative' and confidence > 0.1")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("UDF(" in line for line in filters)
    assert kept.count() == 16


def test_training_evaluates_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    df = spark.createDataFrame(TEXTS, "text string, label int")
    model = train_classifier(df.select(read.asNondeterministic()("text").alias("text"), "label"), max_iter=5)
    assert seen.value == len(TEXTS)
    assert [type(s).__name__ for s in model.stages] == [
        "RegexTokenizer", "HashingTF", "IDFModel", "LogisticRegressionModel",
    ]


def test_texts_without_a_label_stay_out_of_the_shuffle(spark, monkeypatch):
    """Both the training and the test rows meet their texts behind the filter of their own ids."""
    plans = []

    def spying(real):
        def run(df, *args, **options):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df, *args, **options)

        return run

    for name in ("train_classifier", "score"):
        monkeypatch.setattr(registered, name, spying(getattr(registered, name)))
    registered.train_eval(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and all("getbit" in plan for plan in plans)
