import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.metrics import (
    LATENCY_BUCKETS,
    bucket_counts,
    bucket_quantile,
    confidence_buckets,
    gauge_last,
    label_text,
    mean_confidence,
    metrics_snapshot,
    profile_columns,
    profile_of_sketches,
    profile_sketches,
    sentiment_counts,
    sentiment_share,
)

LOG = [("negative", "social", 0.5), ("positive", "social", 0.95), ("positive", "reviews", 0.7)]
SCHEMA = "sentiment string, model_used string, confidence double"


def test_counts_are_zero_filled(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    assert tuple(sentiment_counts(df).first()) == (1, 0, 2, 3)
    assert {r.sentiment: r.pct for r in sentiment_share(df).collect()} == {"negative": 33.0, "neutral": 0.0, "positive": 67.0}
    assert tuple(sentiment_counts(df.limit(0)).first()) == (0, 0, 0, 0)
    assert {r.pct for r in sentiment_share(df.limit(0)).collect()} == {0.0}


def test_bucket_bounds_are_inclusive(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    got = {(r.model_used, r.le): r.n for r in confidence_buckets(df).collect()}
    assert got["social", "0.5"] == 1 and got["social", "0.9"] == 1 and got["social", "0.95"] == 2
    assert got["reviews", "0.6"] == 0 and got["reviews", "+Inf"] == 1
    means = {r.model_used: r.mean_confidence for r in mean_confidence(df).collect()}
    assert means["ensemble"] == pytest.approx(np.mean([0.5, 0.95, 0.7]))


@pytest.mark.parametrize("values, want", [([0.05] * 10, 0.095), ([100.0] * 3, 30.0), ([], None)])
def test_quantile_of_buckets(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "seconds double")
    got = bucket_counts(df, "seconds", LATENCY_BUCKETS).select(bucket_quantile(LATENCY_BUCKETS, 0.95).alias("q")).first().q
    assert got == (pytest.approx(want) if want is not None else None)


def test_quantile_interpolates(spark):
    values = [0.3] * 50 + [2.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "seconds double")
    got = bucket_counts(df, "seconds", LATENCY_BUCKETS).select(bucket_quantile(LATENCY_BUCKETS, 0.95).alias("q")).first().q
    assert got == pytest.approx(1.0 + 1.5 * (95 - 50) / 50)


def test_gauge_keeps_the_last_value(spark):
    rows = [("a", 1, 1, 5.0), ("a", 2, 2, 6.0), ("a", 2, 3, 7.0), ("b", 1, 4, 8.0)]
    df = spark.createDataFrame(rows, "k string, ts int, id int, v double")
    assert {r.k: r.value for r in gauge_last(df, "v", "ts", "id", ["k"]).collect()} == {"a": 7.0, "b": 8.0}


def test_snapshot_labels(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    got = {(r.metric, r.l): r.value for r in metrics_snapshot(df).select("metric", label_text("labels").alias("l"), "value").collect()}
    assert got["predictions_total", "model=social,sentiment=negative"] == 1.0
    assert got["prediction_confidence_bucket", "le=0.95,model=social"] == 2.0
    assert got["prediction_confidence_count", "model=reviews"] == 1.0


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "a int, b string")
    assert {r.column: (r.n_null, r.n_distinct) for r in profile_columns(df).collect()} == {"a": (0, 2), "b": (2, 1)}
    assert {r.column: r.n_null for r in profile_columns(df, approximate=True).collect()} == {"a": 0, "b": 2}


def test_profile_without_copies_of_rows(spark):
    rows = [(1, "a", 1.0), (2, "a", float("nan")), (2, None, float("nan")), (None, None, -0.0), (3, "b", 0.0)]
    df = spark.createDataFrame(rows, "`a.b` int, s string, x double")
    exact = profile_columns(df)
    assert sorted(map(tuple, exact.collect())) == [("a.b", 1, 3), ("s", 2, 2), ("x", 0, 3)]
    assert "Expand" not in exact._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, profile_columns(df.where("false")).collect())) == [("a.b", 0, 0), ("s", 0, 0), ("x", 0, 0)]
    assert {r["column"]: r["n_null"] for r in profile_columns(df, approximate=True).collect()} == {"a.b": 1, "s": 2, "x": 0}


def test_sketches_of_days_merge(spark, tmp_path):
    df = spark.range(20_000).select("id", (F.col("id") % 500).cast("string").alias("few"), F.lit(None).cast("int").alias("none"))
    for day, part in (("1", df.where("id < 12000")), ("2", df.where("id >= 8000"))):  # the days overlap
        profile_sketches(part).write.parquet(str(tmp_path / day))
    days = [spark.read.parquet(str(tmp_path / d)) for d in ("1", "2")]
    merged = {r["column"]: r for r in profile_of_sketches(*days).collect()}
    whole = {r["column"]: r for r in profile_of_sketches(profile_sketches(df)).collect()}
    assert {c: r["n"] for c, r in merged.items()} == dict.fromkeys(("id", "few", "none"), 24_000)
    assert merged["none"]["n_null"] == 24_000 and merged["none"]["n_distinct"] == 0
    for c, n in (("id", 20_000), ("few", 500)):
        assert abs(merged[c]["n_distinct"] - n) <= 0.06 * n and abs(merged[c]["n_distinct"] - whole[c]["n_distinct"]) <= 0.03 * n
    plan = profile_sketches(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
