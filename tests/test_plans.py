"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import plumbline.plans.small as small
from plumbline.operators import binning, drift, split
from plumbline.plans.views import event_rows, predictions, table
from plumbline.registry import all_queries

SF = "/root/testdata/sf0.001"
CHECKED = [
    "stratified_split", "stratified_sample", "random_split", "ensemble_decide", "crm_action_list", "score_cache_hit",
    "score_cache_miss", "quantile_bins", "psi_numeric", "psi_categorical", "drift_summary", "guarded_window",
    "semantic_drift_report", "latency_p95", "gauge_last", "metrics_snapshot", "anchored_91d_tenants",
    "lifecycle_views", "sliding_sentiment",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_anywhere(spark, monkeypatch, name):
    """Neither in the final plan nor in the fitting jobs before it."""
    plans = []
    real = small.fitted

    def spying(df, max_rows=small.MAX_FITTED_ROWS):
        if not isinstance(df, small.Fitted):
            plans.append(plan_of(df))
        return real(df, max_rows)

    for module in (small, binning, drift, split):
        monkeypatch.setattr(module, "fitted", spying)
    plans.append(plan_of(all_queries()[name](spark, SF)))
    for plan in plans:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_split_never_shuffles_the_rows(spark):
    docs = table(spark, SF, "documents").withColumn("label", (F.col("doc_id") % 3).cast("int"))
    plan = plan_of(split.stratified_split(docs, "doc_id", "label"))
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_length_of_a_text_is_taken_before_the_join(spark):
    plan = plan_of(predictions(spark, SF).select("model_used", "text_length"))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("text:string" in s for s in scans)
    above = plan[: plan.index("length(")]
    assert "text#" not in above.replace("text_length", "").replace("text_id", "")


def test_window_filter_reaches_the_scan(spark, tmp_path):
    event_rows(spark, SF).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = plan_of(drift.recent(log, 24, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("row_id"))
    assert "GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<row_id:bigint,ts:timestamp>" in plan


def test_binning_stays_in_generated_code(spark):
    log = event_rows(spark, SF)
    edges = binning.equal_width_edges(log, "confidence", ["model_used"])
    counted = binning.histogram(log, "confidence", edges, ["model_used"])
    assert "filter(edges" not in plan_of(counted)


def test_large_parameter_frames_stay_lazy(spark):
    big = small.fitted(spark.range(50).toDF("g").withColumn("v", F.lit(1)), max_rows=10)
    assert not big.small and big.df.count() == 50
    rows = spark.range(50).toDF("g")
    assert big.attach(rows, ["g"], "v").count() == 50


def test_wanted_rows_pass_the_filter_and_few_others(spark):
    rows = spark.range(20_000).select((F.col("id") - 7).alias("id"), F.lit("wide").alias("text"))
    wanted = spark.createDataFrame([(5,), (5,), (None,), (-3,), (19_000,), (10**12,)], "id long")
    met = small.likely(rows, wanted, "id")
    assert met.columns == rows.columns
    ids = [r.id for r in met.collect()]
    assert {5, -3, 19_000} <= set(ids) and len(ids) == len(set(ids)) < 100
    assert small.likely(rows, wanted.where("false"), "id").isEmpty()
    other = wanted.select(F.col("id").cast("int").alias("id"))  # hashes of other types differ
    assert small.likely(rows, other, "id").count() == 20_000
