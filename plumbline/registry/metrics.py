"""Counters, histograms, gauges and the snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.functions.scores import round_to
from plumbline.operators.metrics import (
    CONFIDENCE_BUCKETS,
    LATENCY_BUCKETS,
    confidence_buckets,
    drift_gauges,
    gauge_last,
    label_text,
    latency_buckets,
    latency_summary,
    mean_confidence,
    metrics_snapshot,
    predictions_total,
    sentiment_counts,
    sentiment_share,
)
from plumbline.operators.lifecycle import lifecycle_gauges
from plumbline.plans.small import fitted
from plumbline.plans.views import event_rows, latencies, order_log, predictions, table
from plumbline.registry import drift, lifecycle, semantic
from plumbline.registry.sql import TS, counts_by, with_views
from plumbline.sources.log import log_rows

drift_summary_query, DRIFT_SQL = drift.ENTRIES["drift_summary"]
semantic_report, SEMANTIC_SQL = semantic.ENTRIES["semantic_drift_report"]
LIFECYCLE_SQL = lifecycle.ENTRIES["lifecycle_views"][1]

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def logged(spark, sf):
    rows = log_rows(predictions(spark, sf), F.col("ts"))
    return rows.withColumn("timestamp", F.date_format("timestamp", TS_FORMAT))


def counts(spark, sf):
    return sentiment_counts(event_rows(spark, sf))


def shares(spark, sf):
    return sentiment_share(event_rows(spark, sf))


def totals(spark, sf):
    return predictions_total(event_rows(spark, sf))


def confidence(spark, sf):
    return confidence_buckets(event_rows(spark, sf))


def confidence_mean(spark, sf):
    out = mean_confidence(event_rows(spark, sf))
    return out.select("model_used", "n", round_to("mean_confidence", 6).alias("mean_confidence"))


def latency(spark, sf):
    return latency_buckets(latencies(spark, sf))


def latency_p95(spark, sf):
    out = latency_summary(latencies(spark, sf))
    return out.select(
        F.date_format("window_start", MINUTE_FORMAT).alias("window_start"),
        "n",
        round_to("mean_latency", 6).alias("mean_latency"),
        round_to("p95", 6).alias("p95"),
    )


def gauges(spark, sf):
    out = gauge_last(table(spark, sf, "events"), "value", "ts", "event_id", ["event_type"])
    return out.select("event_type", "value", F.date_format("ts", TS_FORMAT).alias("ts"))


def snapshot(spark, sf):
    out = metrics_snapshot(event_rows(spark, sf), latencies(spark, sf))
    return out.select("metric", label_text("labels").alias("labels"), round_to("value", 6).alias("value"))


def families(spark, sf):
    """The lifecycle's and the drift's families, which ``metrics_snapshot`` takes as gauges."""
    summary_ = fitted(drift_summary_query(spark, sf)).df
    parts = [*lifecycle_gauges(order_log(spark, sf)), *drift_gauges(summary_, semantic_report(spark, sf))]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("metric", label_text("labels").alias("labels"), round_to("value", 6).alias("value"))


def _le(column: str, bounds, source: str, by: str = "") -> str:
    """Cumulative bucket rows, one branch per bound."""
    group = f"group by {by}" if by else ""
    select = f"{by}, " if by else ""
    parts = [
        f"select {select}'{float(b)}' as le, count(*) filter (where {column} <= {b}::double) as n from {source} {group}"
        for b in bounds
    ]
    parts.append(f"select {select}'+Inf' as le, count({column}) as n from {source} {group}")
    return " union all ".join(parts)


_SECONDS = "(select ts, value / 10::double as seconds from events)"

_P95 = "cast(n as double) * 0.95::double"
_CASES = "".join(
    f" when c{i} >= {_P95} then {lo}::double + {b - lo}::double * ({_P95} - {f'c{i - 1}' if i else 0}) / (c{i} - {f'c{i - 1}' if i else 0})"
    for i, (lo, b) in enumerate(zip((0.0, *LATENCY_BUCKETS[:-1]), LATENCY_BUCKETS))
)
_BUCKET_COUNTS = ", ".join(f"count(*) filter (where seconds <= {b}::double) as c{i}" for i, b in enumerate(LATENCY_BUCKETS))

_LIFE = [
    f"select 'inference_view' as metric, 'sentiment={s}' as labels, {s}::double as value from views where view = 'inference' "
    f"union all select 'accumulation_view', 'sentiment={s}', {s}::double from views where view = 'accumulation' "
    f"union all select 'memory_view', 'period=' || period || ',sentiment={s}', {s}::double from views where view = 'memory'"
    for s in ("negative", "neutral", "positive")
]
_FAMILIES = f"""
with views as ({LIFECYCLE_SQL}), drifts as ({DRIFT_SQL}), semantics as ({SEMANTIC_SQL})
select metric, labels, round(value, 6) as value from (
  {' union all '.join(_LIFE)}
  union all select 'accumulation_total', '', total::double from views where view = 'accumulation'
  union all select 'accumulation_created_at', '', epoch(strptime(period, '%Y-%m-%d')) from views where view = 'accumulation'
  union all select 'drift_' || signal || '_psi', 'model=' || model, psi from drifts where psi is not null
  union all select 'semantic_drift_psi', 'model=' || model, psi from semantics where psi is not null)"""

ENTRIES = {
    "metrics_families": (families, _FAMILIES),
    "prediction_log": (
        logged,
        with_views(
            ["v_predictions"],
            f"select strftime(ts, {TS}) as timestamp, text, text_length, sentiment, label, confidence, model_used from v_predictions",
        ),
    ),
    "sentiment_counts": (counts, with_views(["v_predictions"], f"select {counts_by()} from v_predictions")),
    "sentiment_share": (
        shares,
        with_views(
            ["v_predictions"],
            "select sentiment, count(*) as n, round(count(*)::double / sum(count(*)) over () * 100, 0) as pct from v_predictions group by sentiment",
        ),
    ),
    "predictions_total": (
        totals,
        with_views(["v_predictions"], "select sentiment, model_used, count(*) as n from v_predictions group by all"),
    ),
    "confidence_buckets": (
        confidence,
        with_views(["v_predictions"], _le("confidence", CONFIDENCE_BUCKETS, "v_predictions", "model_used")),
    ),
    "mean_confidence": (
        confidence_mean,
        with_views(
            ["v_predictions"],
            """select coalesce(model_used, 'ensemble') as model_used, count(*) as n, round(avg(confidence), 6) as mean_confidence
            from v_predictions group by rollup (model_used)""",
        ),
    ),
    "latency_buckets": (latency, _le("seconds", LATENCY_BUCKETS, _SECONDS)),
    "latency_p95": (
        latency_p95,
        f"""select strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, n, round(total / n, 6) as mean_latency,
        round(case{_CASES} else {LATENCY_BUCKETS[-1]}::double end, 6) as p95
        from (select time_bucket(interval 5 minutes, ts) as window_start, count(*) as n, sum(seconds) as total, {_BUCKET_COUNTS}
              from {_SECONDS} group by 1)""",
    ),
    "gauge_last": (
        gauges,
        f"""select event_type, value, strftime(ts, {TS}) as ts from (
          select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r = 1""",
    ),
    "metrics_snapshot": (
        snapshot,
        with_views(
            ["v_predictions"],
            f"""select metric, labels, round(value, 6) as value from (
              select 'predictions_total' as metric, 'model=' || model_used || ',sentiment=' || sentiment as labels, count(*)::double as value
                from v_predictions group by model_used, sentiment
              union all select 'prediction_confidence_bucket', 'le=' || le || ',model=' || model_used, n::double
                from ({_le('confidence', CONFIDENCE_BUCKETS, 'v_predictions', 'model_used')})
              union all select 'prediction_confidence_count', 'model=' || model_used, count(*)::double from v_predictions group by model_used
              union all select 'prediction_confidence_sum', 'model=' || model_used, sum(confidence) from v_predictions group by model_used
              union all select 'inference_latency_seconds_bucket', 'le=' || le, n::double from ({_le('seconds', LATENCY_BUCKETS, _SECONDS)})
              union all select 'inference_latency_seconds_count', '', count(*)::double from events
              union all select 'inference_latency_seconds_sum', '', sum(value / 10::double) from events)""",
        ),
    ),
}
