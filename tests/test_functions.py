import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.labels import label_id, label_name, recode_polarity, recode_stars
from plumbline.functions.psi import drift_status, psi, psi_level, risk_pct
from plumbline.functions.scores import decide, round_to, softmax_argmax
from plumbline.functions.text import clean_text, text_length, token_count, truncate_tokens


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


@pytest.mark.parametrize("stars, label", [(1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (9, 9), (None, None)])
def test_stars(spark, stars, label):
    assert one(spark, stars, "int", recode_stars("x")) == label


@pytest.mark.parametrize("polarity, label", [(0, 0), (2, 1), (4, 2), (3, 3), (None, None)])
def test_polarity(spark, polarity, label):
    assert one(spark, polarity, "int", recode_polarity("x")) == label


def test_names_and_ids(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (7,)], "x int")
    got = rows.select(label_name("x").alias("n")).withColumn("i", label_id("n")).collect()
    assert [tuple(r) for r in got] == [("negative", 0), ("neutral", 1), ("positive", 2), (None, None)]


def test_text(spark):
    assert one(spark, "a😀bé", "string", text_length("x")) == 4
    dirty = "  See https://a.b/c?d=1 or www.x.org\tnow!! #great <b>é</b>\n"
    assert one(spark, dirty, "string", clean_text("x")) == "See or now!! great b é b"
    assert one(spark, " a  b\nc ", "string", truncate_tokens("x", 2)) == "a b"
    assert one(spark, " a  b\nc ", "string", token_count("x")) == 3
    assert one(spark, " \n", "string", token_count("x")) == 0
    long = " ".join(str(i) for i in range(2000))
    assert one(spark, long, "string", token_count("x")) == 2000


def test_softmax_argmax(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(50, 3)) * 5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(logits)], "i int, x array<double>")
    for r in df.select("i", softmax_argmax("x").alias("r")).collect():
        e = np.exp(logits[r.i] - logits[r.i].max())
        np.testing.assert_allclose(r.r.probs, e / e.sum(), rtol=1e-12)
        assert r.r.pred == logits[r.i].argmax()
    assert one(spark, [1.0, 2.0, 2.0], "array<double>", softmax_argmax("x")).pred == 1


@pytest.mark.parametrize(
    "first, second, label, confidence, model",
    [
        ((2, 0.8), (2, 0.8), 2, 0.8, "social"),
        ((2, 0.7), (2, 0.8), 2, 0.8, "reviews"),
        ((2, 0.99), (0, 0.40), 0, 0.40, "reviews"),
        ((1, 0.34567), (2, 0.9), 1, 0.3457, "social"),
    ],
)
def test_decision_rule(spark, first, second, label, confidence, model):
    df = spark.createDataFrame(
        [(*first, *second)], "social_pred int, social_conf double, reviews_pred int, reviews_conf double"
    )
    got = decide(df).first()
    assert (got.label, got.confidence, got.model_used) == (label, confidence, model)
    assert got.sentiment == {0: "negative", 1: "neutral", 2: "positive"}[label]


def test_round_keeps_values_below_a_tie_down(spark):
    assert one(spark, 0.08725, "double", round_to("x", 4)) == round(0.08725, 4)
    assert one(spark, 2.5, "double", round_to("x", 0)) == 3.0


@pytest.mark.parametrize(
    "value, level, risk",
    [(0.0, "low", 0.0), (0.0999, "low", 33.3), (0.1, "medium", 33.3), (0.2, "high", 66.7), (0.3, "critical", 100.0),
     (5.0, "critical", 100.0), (None, "unknown", 0.0)],
)
def test_risk(spark, value, level, risk):
    assert one(spark, value, "double", psi_level("x")) == level
    assert one(spark, value, "double", risk_pct("x")) == risk


@pytest.mark.parametrize(
    "value, rows, status",
    [(0.2499, 5, "OK"), (0.25, 5, "ALERT"), (None, 5, "no_baseline"), (None, 0, "no_predictions"), (0.9, None, "no_predictions")],
)
def test_status(spark, value, rows, status):
    df = spark.createDataFrame([(value, rows)], "psi double, n long")
    assert df.select(drift_status("psi", "n").alias("s")).first().s == status


def numpy_psi(expected, actual):
    p, q = np.clip(expected, 1e-4, None), np.clip(actual, 1e-4, None)
    p, q = p / p.sum(), q / q.sum()
    return float(((q - p) * np.log(q / p)).sum())


@pytest.mark.parametrize(
    "expected, actual", [([0.5, 0.5], [0.5, 0.5]), ([0.5, 0.5], [1.0, 0.0]), ([0.1, 0.2, 0.7], [0.3, 0.3, 0.4])]
)
def test_psi(spark, expected, actual):
    df = spark.createDataFrame(list(zip(expected, actual)), "expected double, actual double")
    got = psi(df.withColumn("g", F.rand() * 0), ["g"]).first().psi
    assert got == pytest.approx(numpy_psi(expected, actual), abs=1e-12)
    assert got >= 0
