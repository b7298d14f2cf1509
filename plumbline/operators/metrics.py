"""Counters, histograms, gauges and column profiles in long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import SENTIMENTS
from plumbline.plans.small import fitted

# Upper bounds of the confidence and latency buckets.
CONFIDENCE_BUCKETS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)
LATENCY_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def sentiment_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., negative, neutral, positive, total``; absent classes count zero."""
    counts = [F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]
    total = F.count_if(F.col("sentiment").isin(*SENTIMENTS)).alias("total")
    return df.groupBy(*by).agg(*counts, total)


def sentiment_share(df: DataFrame) -> DataFrame:
    """``sentiment, n, pct``: whole percent of all rows."""
    counts = sentiment_counts(df)
    long = counts.select(
        "total", F.expr("stack(3, 'negative', negative, 'neutral', neutral, 'positive', positive) as (sentiment, n)")
    )
    pct = F.round(F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")) * 100, 0)
    return long.select("sentiment", "n", F.coalesce(pct, F.lit(0.0)).alias("pct"))


def predictions_total(df: DataFrame) -> DataFrame:
    """Counter of scored rows per sentiment and model."""
    return df.groupBy("sentiment", "model_used").agg(F.count(F.lit(1)).alias("n"))


def bucket_counts(
    df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str | Column] = ()
) -> DataFrame:
    """``by..., c0..ck, n, total``: cumulative counts per upper bound in one pass, no row multiplied."""
    x = F.col(value).cast("double")
    inside = [F.count_if(x <= F.lit(float(b))).alias(f"c{i}") for i, b in enumerate(bounds)]
    return df.groupBy(*by).agg(*inside, F.count(x).alias("n"), F.sum(x).alias("total"))


def buckets_long(counts: DataFrame, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by..., le, n`` with the closing ``+Inf`` bucket."""
    names = [str(float(b)) for b in bounds]
    pairs = ", ".join(f"'{b}', c{i}" for i, b in enumerate(names))
    stacked = f"stack({len(names) + 1}, {pairs}, '+Inf', n) as (le, n)"
    return counts.select(*by, F.expr(stacked))


def confidence_buckets(df: DataFrame) -> DataFrame:
    """Cumulative confidence histogram per model."""
    counts = bucket_counts(df, "confidence", CONFIDENCE_BUCKETS, ["model_used"])
    return buckets_long(counts, CONFIDENCE_BUCKETS, ["model_used"])


def mean_confidence(df: DataFrame) -> DataFrame:
    """Mean confidence per model and over all models."""
    per_model = df.groupBy("model_used").agg(
        F.sum("confidence").alias("s"), F.count("confidence").alias("n")
    )
    return (
        per_model.rollup("model_used")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        .select(
            F.coalesce("model_used", F.lit("ensemble")).alias("model_used"),
            "n",
            (F.col("s") / F.col("n")).alias("mean_confidence"),
        )
    )


def bucket_quantile(bounds: Sequence[float], q: float) -> Column:
    """Quantile of the columns of ``bucket_counts`` by interpolation inside the bucket.

    The first bucket starts at zero; a rank beyond the last finite bound
    returns that bound.
    """
    rank = F.lit(q) * F.col("n").cast("double")
    out = F.when(F.col("n") == 0, F.lit(None).cast("double"))
    below, lower = F.lit(0).cast("long"), 0.0
    for i, bound in enumerate(bounds):
        c = F.col(f"c{i}")
        inside = (c - below).cast("double")
        value = F.lit(lower) + F.lit(float(bound) - lower) * F.try_divide(rank - below, inside)
        out = out.when(c.cast("double") >= rank, value)
        below, lower = c, float(bound)
    return out.otherwise(F.lit(float(bounds[-1])))


def latency_summary(
    df: DataFrame, value: str = "seconds", ts: str = "ts", width: str = "5 minutes", q: float = 0.95
) -> DataFrame:
    """``window_start, n, mean_latency, p95`` per tumbling window."""
    windowed = df.withColumn("window_start", F.window(ts, width)["start"])
    counts = bucket_counts(windowed, value, LATENCY_BUCKETS, ["window_start"])
    return counts.select(
        "window_start",
        "n",
        (F.col("total") / F.col("n")).alias("mean_latency"),
        bucket_quantile(LATENCY_BUCKETS, q).alias("p95"),
    )


def latency_buckets(df: DataFrame, value: str = "seconds") -> DataFrame:
    """Cumulative latency histogram over all rows."""
    return buckets_long(bucket_counts(df, value, LATENCY_BUCKETS), LATENCY_BUCKETS)


def gauge_last(df: DataFrame, value: str, ts: str, id_col: str, labels: Sequence[str]) -> DataFrame:
    """The last value per label set; rows at the same time are ordered by id.

    The last times come first, one per label set, and only rows at those times
    are compared by id. Both aggregates keep fixed-width state; ordering by a
    struct of time and id would sort all rows of every task instead.
    """
    last = fitted(df.groupBy(*labels).agg(F.max(ts).alias("_last")))
    at_last = last.attach(df.select(*labels, value, ts, id_col), labels, "_last").where(
        F.col(ts) == F.col("_last")
    )
    return at_last.groupBy(*labels).agg(
        F.max_by(value, id_col).alias("value"), F.max(ts).alias("ts")
    )


#: Buckets of a distinct sketch as a power of two: 4 KB or less, two percent off.
SKETCH_BITS = 12


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """``column, n_null, n_distinct`` of every column.

    Exact counts take every column by itself: its values are counted, copies collapsing before the
    shuffle, and both results come out of those counts. No row is copied once per column, and a
    columnar file is read once in all; write a frame that is costly to compute first.
    ``approximate`` takes one aggregate of fixed-size sketches instead.
    """
    names = list(columns or df.columns)
    if approximate:
        return profile_of_sketches(profile_sketches(df, names)).drop("n")
    parts = []
    for c in names:
        values = df.select(F.col(f"`{c}`").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        nulls = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
        parts.append(
            values.agg(nulls.alias("n_null"), F.count("v").alias("n_distinct")).select(
                F.lit(c).alias("column"), "n_null", "n_distinct"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, n, n_null, sketch`` of every column, in one aggregate of a row per task.

    Sketches have a fixed size and merge, so those of each day can be stored and a profile of any
    span of days comes out of them (``profile_of_sketches``) without its rows.
    """
    names = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        value = F.col(f"`{c}`")
        aggs.append(F.count_if(value.isNull()).alias(f"null_{i}"))
        # A null is no value; the hash makes every type one the sketch takes.
        aggs.append(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), SKETCH_BITS).alias(f"sketch_{i}"))
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"null_{i}").alias("n_null"), F.col(f"sketch_{i}").alias("sketch"))
                for i, c in enumerate(names)
            ]
        )
    )
    return df.agg(*aggs).select("n", rows.alias("r")).select("r.column", "n", "r.n_null", "r.sketch")


def profile_of_sketches(*sketches: DataFrame) -> DataFrame:
    """``column, n, n_null, n_distinct`` of the rows behind all sketches together."""
    whole = reduce(lambda a, b: a.unionByName(b), sketches)
    return whole.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum("n_null").alias("n_null"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, null included."""
    return df.select(column).distinct()


# ---------------------------------------------------------------- snapshot


def series(df: DataFrame, metric: str, value: str | Column, labels: Sequence[str | tuple[str, str]] = ()) -> DataFrame:
    """``metric, labels, value`` of a frame with one row per label set."""
    pairs: list[Column] = []
    for item in labels:
        name, column = (item, item) if isinstance(item, str) else item
        pairs += [F.lit(name), F.col(column).cast("string")]
    tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    source = F.col(value) if isinstance(value, str) else value
    return df.select(F.lit(metric).alias("metric"), tags.alias("labels"), source.cast("double").alias("value"))


def metrics_snapshot(log: DataFrame, latency: DataFrame | None = None, gauges: Sequence[DataFrame] = ()) -> DataFrame:
    """Every metric series as ``metric, labels, value``.

    The log is read once for counters and the confidence histogram: both come
    out of one aggregate per sentiment and model.
    """
    bounds = CONFIDENCE_BUCKETS
    base = fitted_counts(log)
    per_model = base.groupBy("model_used").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(bounds))],
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
    )
    parts = [
        series(base, "predictions_total", "n", ["sentiment", ("model", "model_used")]),
        series(
            buckets_long(per_model, bounds, ["model_used"]),
            "prediction_confidence_bucket", "n", [("model", "model_used"), "le"],
        ),
        series(per_model, "prediction_confidence_count", "n", [("model", "model_used")]),
        series(per_model, "prediction_confidence_sum", "total", [("model", "model_used")]),
    ]
    if latency is not None:
        counts = bucket_counts(latency, "seconds", LATENCY_BUCKETS)
        parts += [
            series(buckets_long(counts, LATENCY_BUCKETS), "inference_latency_seconds_bucket", "n", ["le"]),
            series(counts, "inference_latency_seconds_count", "n"),
            series(counts, "inference_latency_seconds_sum", "total"),
        ]
    return reduce(lambda a, b: a.unionByName(b), [*parts, *gauges])


def drift_gauges(summary: DataFrame, semantic: DataFrame | None = None) -> list[DataFrame]:
    """PSI per model of a drift summary, and of a semantic report, as gauges; models without a score have none."""
    known = summary.where(F.col("psi").isNotNull())
    parts = [
        series(known.where(F.col("signal") == s), f"drift_{s}_psi", "psi", ["model"]) for s in ("data", "prediction", "target")
    ]
    if semantic is not None:
        parts.append(series(semantic.where(F.col("psi").isNotNull()), "semantic_drift_psi", "psi", ["model"]))
    return parts


def fitted_counts(log: DataFrame) -> DataFrame:
    """Confidence bucket counts per sentiment and model, evaluated once."""
    return fitted(bucket_counts(log, "confidence", CONFIDENCE_BUCKETS, ["sentiment", "model_used"])).df


def label_text(labels: str | Column = "labels") -> Column:
    """Label map as ``a=1,b=2`` in name order."""
    source = F.col(labels) if isinstance(labels, str) else labels
    entries = F.array_sort(F.map_entries(source))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
