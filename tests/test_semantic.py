from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import semantic
from plumbline.operators.drift import INSUFFICIENT
from plumbline.operators.semantic import (
    assign_clusters,
    cluster_share,
    encode,
    encode_with,
    fit_encoder,
    fit_semantic,
    mean_centroids,
    nearest_centroid,
    semantic_baselines,
    semantic_drift_job,
    semantic_psi,
)
from plumbline.sources.baselines import load_semantic, save_semantic
from test_functions import numpy_psi


def vectors(spark, n=200, d=8, seed=0):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 4, n)
    x = (rng.normal(size=(n, d)) + labels[:, None] * 3).astype(np.float32)
    rows = [(int(i), int(label), v.tolist()) for i, (label, v) in enumerate(zip(labels, x))]
    return spark.createDataFrame(rows, "id long, label int, embedding array<float>"), x, labels


def test_nearest_mean_equals_numpy(spark):
    df, x, labels = vectors(spark)
    centroids = mean_centroids(df)
    means = np.array([x[labels == k].astype(float).mean(axis=0) for k in range(4)])
    got = {r.cluster: r.centroid for r in centroids.collect()}
    np.testing.assert_allclose([got[k] for k in range(4)], means, rtol=1e-9)
    want = ((x[:, None, :].astype(float) - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    found = {r.id: r.cluster for r in nearest_centroid(df, centroids).collect()}
    assert [found[i] for i in range(len(x))] == want.tolist()


def test_projection_spans_the_leading_directions(spark):
    df, x, _ = vectors(spark)
    model = fit_semantic(df, "id", components=3, clusters=4).model
    loadings = model.stages[0].pc.toArray()
    _, _, vt = np.linalg.svd(x.astype(float) - x.astype(float).mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs((loadings * vt[:3].T).sum(axis=0)), 1.0, atol=1e-6)


def test_fitted_baseline_round_trip(spark, tmp_path):
    df, _, _ = vectors(spark)
    fitted = fit_semantic(df, "id", strata=["label"], clusters=4)
    assert fitted.expected.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    save_semantic(fitted, str(tmp_path), "social")
    again = load_semantic(spark, str(tmp_path), "social")
    one = assign_clusters(df, fitted.model).orderBy("id").collect()
    two = assign_clusters(df, again.model).orderBy("id").collect()
    assert one == two
    shares = {r.cluster: r.share for r in cluster_share(assign_clusters(df, again.model), 4).collect()}
    assert shares == {r.cluster: r.share for r in again.expected.collect()}
    assert load_semantic(spark, str(tmp_path), "reviews") is None


def test_fewer_rows_than_clusters(spark):
    df, _, _ = vectors(spark, n=3)
    assert fit_semantic(df, "id").expected.count() == 3


def test_encoders(spark):
    df = spark.createDataFrame([(0, "a b c"), (1, "a b d"), (2, "x y z")], "id int, text string")
    got = encode(df, fit_encoder(df, features=64)).collect()
    assert all(len(r.embedding) == 64 for r in got)
    assert np.linalg.norm(got[0].embedding) == pytest.approx(1.0)

    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    assert [r.embedding for r in encode_with(df, load).orderBy("id").collect()] == [[5.0, 1.0], [5.0, 1.0], [5.0, 0.0]]


def cluster_rows(spark, counts, end, hours):
    rows = []
    for (model, cluster), n in counts.items():
        rows += [(model, cluster, end - timedelta(hours=hours))] * n
    return spark.createDataFrame(rows + [("social", 0, end)], "model_used string, cluster int, ts timestamp")


def test_semantic_psi_and_report(spark):
    end = datetime(2024, 2, 1)
    expected = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.5), (2, 0, 0.0)], "cluster int, n long, share double")
    base = semantic_baselines(expected)
    log = cluster_rows(spark, {("social", 0): 299, ("social", 1): 300, ("reviews", 2): 100}, end, 2)
    got = {r.model: r.psi for r in semantic_psi(log, base).collect()}
    assert got["social"] == pytest.approx(0, abs=1e-9)
    assert got["reviews"] == pytest.approx(numpy_psi(np.array([0.5, 0.5, 0]), np.array([0, 0, 1.0])))
    report = {r.model: r for r in semantic_drift_job(log, base).collect()}
    assert report["reviews"].status == "ALERT" and report["ensemble"].status == "ALERT"
    assert report["social"].status == "OK" and report["social"].window_hours == 24
    few = semantic_drift_job(log.limit(20), base).collect()
    assert [(r.status, r.psi, r.window_hours) for r in few] == [(INSUFFICIENT, None, 168)]


def test_component_count_is_bounded_by_rows(spark):
    df, _, _ = vectors(spark, n=40, d=2)
    out = fit_semantic(df, "id").model.transform(
        df.withColumn("_vector", array_to_vector(F.col("embedding").cast("array<double>")))
    )
    assert len(out.select(vector_to_array("_reduced").alias("r")).first().r) == 2



def test_nearest_rows_equal_plain_differences():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 8))
    points[200:] = points[:100]  # exact ties: the first counts
    x = np.concatenate([rng.normal(size=(500, 8)), points[:50], 1e8 + rng.normal(size=(50, 8)), np.zeros((1, 8))])
    want = np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)
    at, least = semantic.nearest_rows(x, points)
    assert (at == want.argmin(axis=1)).all() and (least == want.min(axis=1)).all()


@pytest.mark.parametrize("numbers", [1 << 21, 40, 4])
def test_blocks_of_centroids_do_not_matter(spark, monkeypatch, numbers):
    """All centroids at once, ten of them, and one by one, so that rows are written in between."""
    rng = np.random.default_rng(4)
    x, centres = rng.normal(size=(60, 4)), rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "_best int, embedding array<double>")
    monkeypatch.setattr(semantic, "CENTROID_NUMBERS", numbers)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centroid array<double>")
    got = semantic.nearest_centroid(df, centroids)
    assert got.columns == ["_best", "embedding", "cluster"]
    want = {i: int(((v - centres) ** 2).sum(axis=1).argmin()) for i, v in enumerate(x)} | {-1: None}
    assert {r["_best"]: r["cluster"] for r in got.collect()} == want
    assert semantic.nearest_centroid(df, centroids.where("false")).where("cluster is not null").count() == 0
