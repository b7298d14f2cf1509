from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.drift import (
    DATA,
    INSUFFICIENT,
    PREDICTION,
    SIGNALS,
    TARGET,
    build_baselines,
    drift_summary,
    guarded_window,
    production_psi,
    recent,
    volume_guardrail,
)
from test_binning import numpy_edges
from test_functions import numpy_psi

END = datetime(2024, 1, 31)
SCHEMA = "model_used string, text_length int, label int, confidence double"


def make(seed, n=400, shift=0, models=("social", "reviews")):
    rng = np.random.default_rng(seed)
    return [
        (m, int(x) + shift, int(y), float(c))
        for m in models
        for x, y, c in zip(rng.integers(1, 300, n), rng.integers(0, 3, n), rng.uniform(0.34, 1, n).round(4))
    ]


def test_psi_equals_numpy(spark):
    train, prod = make(0), make(1, shift=40)
    base = build_baselines(spark.createDataFrame(train, SCHEMA))
    got = {(r.model, r.signal): (r.psi, r.rows) for r in production_psi(spark.createDataFrame(prod, SCHEMA), base).collect()}
    for m in ("social", "reviews"):
        for signal, i in (("data", 1), ("prediction", 3)):
            t = np.array([r[i] for r in train if r[0] == m], float)
            p = np.array([r[i] for r in prod if r[0] == m], float)
            edges = numpy_edges(t) if signal == "data" else np.linspace(t.min(), t.max(), 11)
            a, b = np.histogram(t, edges)[0], np.histogram(p, edges)[0]
            psi, rows = got[m, signal]
            assert psi == pytest.approx(numpy_psi(a / a.sum(), b / b.sum()), abs=1e-9)
            assert rows == b.sum()
        t = [r[2] for r in train if r[0] == m]
        p = [r[2] for r in prod if r[0] == m]
        share = lambda v: np.array([v.count(c) / len(v) for c in (0, 1, 2)])
        assert got[m, "target"][0] == pytest.approx(numpy_psi(share(t), share(p)), abs=1e-9)


def test_same_rows_have_no_drift(spark):
    df = spark.createDataFrame(make(0), SCHEMA)
    for r in drift_summary(df, build_baselines(df)).collect():
        assert (r.psi, r.level, r.status) == (0.0, "low", "OK")


def test_all_values_outside_the_edges_compare_with_a_uniform_share(spark):
    train = spark.createDataFrame([("social", i, 0, 0.5 + i / 1000) for i in range(100)], SCHEMA)
    prod = spark.createDataFrame([("social", 10_000 + i, 0, 0.5) for i in range(9)], SCHEMA)
    base = build_baselines(train, [DATA])
    r = production_psi(prod, base, [DATA]).first()
    assert r.rows == 0 and r.psi == pytest.approx(numpy_psi(np.full(10, 0.1), np.full(10, 0.1)), abs=1e-9)


def test_new_label_counts_in_the_total_only(spark):
    train = spark.createDataFrame([("social", 1, 0, 0.5), ("social", 1, 1, 0.5)], SCHEMA)
    prod = spark.createDataFrame([("social", 1, 0, 0.5), ("social", 1, 2, 0.5)], SCHEMA)
    r = production_psi(prod, build_baselines(train, [TARGET]), [TARGET]).first()
    assert r.psi == pytest.approx(numpy_psi(np.array([0.5, 0.5]), np.array([0.5, 0.0])), abs=1e-12)


def test_missing_scores_use_the_fixed_confidence_bins(spark):
    train = spark.createDataFrame([("social", 1, 0, None)] * 3, SCHEMA)
    base = build_baselines(train, [PREDICTION]).orderBy("bin").collect()
    assert [r.lo for r in base] == [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    assert all(r.expected == pytest.approx(1 / 7) for r in base)


def test_constant_confidence(spark):
    train = spark.createDataFrame([("social", 1, 0, 0.7)] * 5, SCHEMA)
    r = production_psi(train, build_baselines(train, [PREDICTION]), [PREDICTION]).first()
    assert r.psi == 0.0


def test_summary_names_what_is_missing(spark):
    train = spark.createDataFrame(make(0, models=("social",)), SCHEMA)
    base = build_baselines(train, SIGNALS)
    prod = spark.createDataFrame(make(1, models=("reviews",)), SCHEMA)
    got = {(r.model, r.signal): r.status for r in drift_summary(prod, base).collect()}
    assert got["social", "data"] == "no_predictions"
    assert got["reviews", "data"] == "no_baseline"
    assert got["ensemble", "data"] == "no_baseline"


def test_ensemble_is_the_worst_model(spark):
    base = build_baselines(spark.createDataFrame(make(0), SCHEMA))
    prod = make(1, models=("social",)) + make(2, shift=200, models=("reviews",))
    got = {(r.model, r.signal): r for r in drift_summary(spark.createDataFrame(prod, SCHEMA), base).collect()}
    assert got["ensemble", "data"].psi == max(got["social", "data"].psi, got["reviews", "data"].psi)
    assert got["ensemble", "data"].n == 800 and got["reviews", "data"].status == "ALERT"


def log_at(spark, ages):
    rows = [(i, END - timedelta(hours=a)) for i, a in enumerate(ages)]
    return spark.createDataFrame(rows, "row_id int, ts timestamp")


@pytest.mark.parametrize("inside, window", [(499, 168), (500, 24)])
def test_guardrail(spark, inside, window):
    df = log_at(spark, [0] + [1] * (inside - 1) + [100] * 50 + [500] * 10)
    r = volume_guardrail(df).first()
    assert (r.n_window, r.window_hours, r.lookback_expanded, r.status) == (inside, window, window == 168, "OK")
    assert guarded_window(df).count() == (inside + 50 if window == 168 else inside)


def test_guardrail_gives_up(spark):
    df = log_at(spark, [0, 30, 60, 900])
    r = volume_guardrail(df).first()
    assert (r.status, r.total_predictions) == (INSUFFICIENT, 3)
    assert guarded_window(df).isEmpty()


def test_window_edge_is_inside(spark):
    df = log_at(spark, [0, 24, 24.001])
    assert recent(df).count() == 2
    assert recent(df, 24, F.lit("2024-01-31").cast("timestamp")).count() == 2


def test_baselines_of_added_batches_equal_those_of_all_rows(spark, tmp_path):
    from plumbline.operators.drift import baseline_counts, baselines_of_counts
    from plumbline.sources.baselines import add_training_counts, load_training_counts

    rng = np.random.default_rng(9)
    data = [
        (["social", "reviews"][i % 2], int(rng.integers(1, 90)), int(rng.integers(0, 12)), round(float(rng.uniform(0.3, 1)), 2) if i % 17 else None)
        for i in range(3_000)
    ] + [("empty", None, None, None)] * 3
    train = spark.createDataFrame(data, "model_used string, text_length int, label int, confidence double").repartition(5)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    whole = rows(build_baselines(train))
    path = str(tmp_path / "counts")
    for batch, part in (("a", "text_length < 20"), ("b", "not (text_length < 20) or text_length is null"), ("a", "text_length < 20")):
        add_training_counts(baseline_counts(train.where(part)), path, batch)
    assert rows(baselines_of_counts(load_training_counts(spark, path))) == whole
    assert rows(baselines_of_counts(load_training_counts(spark, path, ["a"]))) == rows(build_baselines(train.where("text_length < 20")))
    assert load_training_counts(spark, str(tmp_path / "none")).isEmpty()
