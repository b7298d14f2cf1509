"""Drift: baselines, production PSI, volume guardrail and the summary over models.

A baseline is one long table, a row per (model, signal, feature, bin), so that
all models and all signals are handled by one plan: rows are binned in a
narrow pass and counted by the combination of their bins before the only
shuffle; the counts, not the rows, are then taken apart by signal.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.labels import MODELS
from plumbline.functions.psi import drift_status, psi, with_risk
from plumbline.operators.binning import (
    bin_index,
    counted_quantile_edges,
    equal_width_edges,
    histogram,
    most_edges,
    quantile_edges,
    share,
    value_counts,
)
from plumbline.plans.small import fitted, stored

# Hours of the drift window, of its fallback, and the least volume.
WINDOW_HOURS = 24
FALLBACK_HOURS = 168
MIN_ROWS = 500
INSUFFICIENT = "INSUFFICIENT_VOLUME_FOR_DRIFT"

KEYS = ("model", "signal", "feature")
BASELINE_COLUMNS = (*KEYS, "kind", "bin", "lo", "hi", "category", "expected")


@dataclass(frozen=True)
class Signal:
    """One thing to watch: ``kind`` is quantile, width or category.

    Numeric kinds differ in how the baseline places its edges. Cluster ids are
    a category column.
    """

    name: str
    kind: str
    column: str


DATA = Signal("data", "quantile", "text_length")
TARGET = Signal("target", "category", "label")
PREDICTION = Signal("prediction", "width", "confidence")
SIGNALS = (DATA, TARGET, PREDICTION)


# ---------------------------------------------------------------- baselines


def _category_bins(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Bins of ``model, category, n``: the categories are stored with a baseline, so one small count is all it takes."""
    of_model = Window.partitionBy("model")
    none = F.lit(None).cast("double")
    return counts.select(
        "model",
        (F.row_number().over(of_model.orderBy(*order)) - 1).alias("bin"),
        none.alias("lo"),
        none.alias("hi"),
        "category",
        (F.col("n").cast("double") / F.sum("n").over(of_model).cast("double")).alias("freq"),
    )


def _numeric_bins(rows: DataFrame, column: str, kind: str, counted: bool) -> DataFrame:
    """Bins of a number; ``counted`` rows are value counts ``model, x, n`` and stand for ``n`` rows each."""
    by = ["model"]
    if kind == "width":
        edges = equal_width_edges(rows, column, by)
    else:
        edges = counted_quantile_edges(rows, by) if counted else quantile_edges(rows, column, by)
        edges = edges.withColumn("measured", F.lit(True))
    params = fitted(edges)
    bins = Window.partitionBy("model")
    return (
        histogram(rows, column, params, by, weight="n" if counted else None)
        .join(params.hinted().select("model", "measured"), "model")
        # Fixed edges stand for "nothing measured yet": every bin is expected alike.
        .withColumn(
            "freq",
            F.when(F.col("measured"), F.col("freq")).otherwise(
                F.lit(1.0) / F.count(F.lit(1)).over(bins)
            ),
        )
        .withColumn("category", F.lit(None).cast("string"))
    )


def _as_baseline(bins: DataFrame, signal: Signal) -> DataFrame:
    return bins.select(
        "model",
        F.lit(signal.name).alias("signal"),
        F.lit(signal.column).alias("feature"),
        F.lit(signal.kind).alias("kind"),
        "bin",
        "lo",
        "hi",
        "category",
        F.col("freq").alias("expected"),
    )


def build_baseline(train: DataFrame, signal: Signal, model_col: str = "model_used") -> DataFrame:
    """Expected shares of one signal for every model in the training frame."""
    rows, column = train.withColumnRenamed(model_col, "model"), signal.column
    if signal.kind == "category":
        known = rows.where(F.col(column).isNotNull())
        counts = known.groupBy("model", F.col(column).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
        counts = fitted(counts.withColumn("category", F.col("_c").cast("string"))).df
        return _as_baseline(_category_bins(counts, ["_c"]), signal)
    if signal.kind == "quantile" and isinstance(train.schema[column].dataType, T.IntegralType):
        # Whole numbers are read once, for how often each occurs.
        counts = stored(value_counts(rows, column, ["model"]), "value-counts")
        return _as_baseline(_numeric_bins(counts, "x", signal.kind, True), signal)
    return _as_baseline(_numeric_bins(rows, column, signal.kind, False), signal)


def baseline_counts(
    train: DataFrame, signals: Sequence[Signal] = SIGNALS, model_col: str = "model_used"
) -> DataFrame:
    """``model, signal, feature, x, category, n``: what the baselines of a training batch are made of.

    Numbers are counted by value, so this is for features with few distinct values (lengths, labels,
    rounded scores). Counts of several batches add up to those of all their rows, exactly.
    """
    rows = train.withColumnRenamed(model_col, "model")
    parts = []
    for s in signals:
        name = [F.lit(s.name).alias("signal"), F.lit(s.column).alias("feature")]
        if s.kind == "category":
            number = isinstance(train.schema[s.column].dataType, T.NumericType)
            x = F.col(s.column).cast("double") if number else F.lit(None).cast("double")
            own = rows.where(F.col(s.column).isNotNull()).select("model", x.alias("x"), F.col(s.column).cast("string").alias("category"))
            counts = own.groupBy("model", "x", "category").agg(F.count(F.lit(1)).alias("n"))
        else:
            counts = value_counts(rows, s.column, ["model"]).withColumn("category", F.lit(None).cast("string"))
        parts.append(counts.select("model", *name, "x", "category", "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def baselines_of_counts(counts: DataFrame, signals: Sequence[Signal] = SIGNALS) -> DataFrame:
    """The baseline table of counts, those of several batches added up: equal to that of all their rows."""
    whole = stored(counts.groupBy(*KEYS, "x", "category").agg(F.sum("n").alias("n")), "baseline-counts")
    parts = []
    for s in signals:
        own = whole.where((F.col("signal") == s.name) & (F.col("feature") == s.column))
        if s.kind == "category":
            bins = _category_bins(own, ["x", "category"])
        else:
            bins = _numeric_bins(own.select("model", "x", "n"), "x", s.kind, True)
        parts.append(_as_baseline(bins, s))
    return fitted(reduce(lambda a, b: a.unionByName(b), parts)).df


def build_baselines(
    train: DataFrame, signals: Sequence[Signal] = SIGNALS, model_col: str = "model_used"
) -> DataFrame:
    """The baseline table of all models and signals."""
    parts = [build_baseline(train, s, model_col) for s in signals]
    return fitted(reduce(lambda a, b: a.unionByName(b), parts)).df


# ---------------------------------------------------------------- production


def _numeric(signal: Signal) -> bool:
    return signal.kind != "category"


def signal_keys(
    log: DataFrame, baselines: DataFrame, signals: Sequence[Signal], model_col: str, extra: Sequence[str] = ()
) -> DataFrame:
    """``extra..., model, k0, k1, ...``: the bin or category of every signal, as text.

    A numeric value outside the edges has no key.
    """
    numeric = [(i, s) for i, s in enumerate(signals) if _numeric(s)]
    rows = log.withColumnRenamed(model_col, "model")
    if numeric:
        ordered = F.array_sort(F.collect_set(F.struct("bin", "lo", "hi")))
        per_model = fitted(
            baselines.where(F.col("kind") != "category")
            .groupBy("model", "signal", "feature")
            .agg(ordered.alias("b"))
            .withColumn("edges", F.concat(F.col("b.lo"), F.slice("b.hi", -1, 1)))
            .groupBy("model")
            .agg(
                *[
                    F.max(
                        F.when(
                            (F.col("signal") == s.name) & (F.col("feature") == s.column), F.col("edges")
                        )
                    ).alias(f"_e{i}")
                    for i, s in numeric
                ]
            )
        )
        rows = rows.withColumns({f"_x{i}": F.col(s.column).cast("double") for i, s in numeric})
        rows = rows.join(per_model.hinted(), "model", "left")
        n_edges = most_edges(per_model, *[f"_e{i}" for i, _ in numeric])
    keys = []
    for i, s in enumerate(signals):
        key = bin_index(f"_x{i}", f"_e{i}", n_edges) if _numeric(s) else F.col(s.column)
        keys.append(key.cast("string").alias(f"k{i}"))
    return rows.select(*extra, "model", *keys)


def joint_counts(keyed: DataFrame, signals: Sequence[Signal], extra: Sequence[str | Column] = ()) -> DataFrame:
    """``extra..., model, k0, k1, ..., n``: rows by the combination of their keys.

    A row is counted once for all signals; the combinations are few, and hold every signal's counts
    as well as the number of rows.
    """
    return keyed.groupBy(*extra, "model", *(f"k{i}" for i in range(len(signals)))).agg(F.count(F.lit(1)).alias("n"))


def per_signal(joint: DataFrame, signals: Sequence[Signal], extra: Sequence[str] = ()) -> DataFrame:
    """``extra..., model, signal, feature, key, n`` of joint counts: counts are repeated per signal, rows never were."""
    each = [
        F.struct(F.lit(s.name).alias("signal"), F.lit(s.column).alias("feature"), F.col(f"k{i}").alias("key"))
        for i, s in enumerate(signals)
    ]
    long = joint.select(*extra, "model", "n", F.explode(F.array(*each)).alias("_s")).select(*extra, "model", "_s.*", "n")
    # A row without a key counts zero but shows that the model had rows.
    return long.groupBy(*extra, *KEYS, "key").agg(F.sum(F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0)).alias("n"))


def psi_of_counts(counts: DataFrame, baselines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``extra..., model, signal, feature, psi, rows`` from bin counts.

    Bins without a row count zero. Unlisted categories count in the total only.
    """
    by = [*extra, *KEYS]
    totals = counts.groupBy(*by).agg(F.sum("n").alias("rows"))
    expected = baselines.select(
        *KEYS, F.coalesce("category", F.col("bin").cast("string")).alias("key"), "expected"
    )
    frame = totals.join(expected, list(KEYS)).join(counts, [*by, "key"], "left")
    actual = share(
        F.coalesce("n", F.lit(0)), F.col("rows"), F.count(F.lit(1)).over(Window.partitionBy(*by))
    )
    scores = psi(frame.withColumn("actual", actual), by)
    return totals.join(scores, by, "left")


def production_counts(
    log: DataFrame, baselines: DataFrame, signals: Sequence[Signal] = SIGNALS, model_col: str = "model_used"
) -> DataFrame:
    """The joint counts of a log, evaluated once: scores and volumes come out of them."""
    return stored(joint_counts(signal_keys(log, baselines, signals, model_col), signals), "joint-counts")


def production_psi(
    log: DataFrame,
    baselines: DataFrame,
    signals: Sequence[Signal] = SIGNALS,
    model_col: str = "model_used",
) -> DataFrame:
    """``model, signal, feature, psi, rows`` of the log against the baselines.

    A model without a baseline has a null score.
    """
    return psi_of_counts(per_signal(production_counts(log, baselines, signals, model_col), signals), baselines)


# ---------------------------------------------------------------- summary


def drift_summary(
    log: DataFrame,
    baselines: DataFrame,
    signals: Sequence[Signal] = SIGNALS,
    models: Sequence[str] = MODELS,
    model_col: str = "model_used",
) -> DataFrame:
    """Scores per model and signal, and the ensemble, which is the worst model.

    Several features of a signal count by their worst as well. Models without
    rows or without a baseline are reported with their reason. The log is read
    once: a model's volume is the sum of its counts.
    """
    joint = production_counts(log, baselines, signals, model_col)
    scores = psi_of_counts(per_signal(joint, signals), baselines)
    volume = joint.groupBy("model").agg(F.sum("n").alias("n"))
    return summarise(scores, volume, [s.name for s in signals], models)


def summarise(scores: DataFrame, volume: DataFrame, signals: Sequence[str], models: Sequence[str]) -> DataFrame:
    """``model, signal, psi, level, risk_pct, status, n`` with the ensemble rows."""
    spark = scores.sparkSession
    wanted = spark.createDataFrame(
        [(m, s) for m in models for s in dict.fromkeys(signals)], "model string, signal string"
    )
    worst = scores.groupBy("model", "signal").agg(F.max("psi").alias("psi"))
    per_model = (
        F.broadcast(wanted)
        .join(worst, ["model", "signal"], "left")
        .join(volume, "model", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    ensemble = per_model.groupBy("signal").agg(F.max("psi").alias("psi"), F.sum("n").alias("n"))
    both = per_model.unionByName(ensemble.withColumn("model", F.lit("ensemble")))
    return with_risk(both.withColumn("status", drift_status("psi", "n"))).select(
        "model", "signal", "psi", "level", "risk_pct", "status", "n"
    )


# ---------------------------------------------------------------- windows


def latest(df: DataFrame, ts: str = "ts") -> Column:
    """The last time in the frame, as a scalar subquery."""
    return df.agg(F.max(ts)).scalar()


def recent(df: DataFrame, hours: int = WINDOW_HOURS, now: Column | None = None, ts: str = "ts") -> DataFrame:
    """Rows at or after ``now`` less ``hours``; give ``now`` as a literal to push the filter down."""
    end = latest(df, ts) if now is None else now
    return df.where(F.col(ts) >= end - F.expr(f"interval {int(hours)} hours"))


def volume_guardrail(
    df: DataFrame,
    hours: int = WINDOW_HOURS,
    fallback: int = FALLBACK_HOURS,
    min_rows: int = MIN_ROWS,
    now: Column | None = None,
    ts: str = "ts",
) -> DataFrame:
    """One row saying which window applies and whether it holds enough rows."""
    end = latest(df, ts) if now is None else now
    longest = max(hours, fallback)
    inside = recent(df, longest, end, ts)
    hour = F.col(ts) >= end - F.expr(f"interval {int(hours)} hours")
    week = F.col(ts) >= end - F.expr(f"interval {int(fallback)} hours")
    counted = inside.agg(F.count_if(hour).alias("n_window"), F.count_if(week).alias("n_fallback"))
    expanded = F.col("n_window") < min_rows
    total = F.when(F.col("lookback_expanded"), F.col("n_fallback")).otherwise(F.col("n_window"))
    return (
        counted.withColumn("lookback_expanded", expanded)
        .withColumn(
            "window_hours", F.when(F.col("lookback_expanded"), F.lit(fallback)).otherwise(F.lit(hours))
        )
        .withColumn("total_predictions", total)
        .withColumn(
            "status", F.when(F.col("total_predictions") < min_rows, INSUFFICIENT).otherwise("OK")
        )
    )


def guarded_window(
    df: DataFrame,
    hours: int = WINDOW_HOURS,
    fallback: int = FALLBACK_HOURS,
    min_rows: int = MIN_ROWS,
    now: Column | None = None,
    ts: str = "ts",
) -> DataFrame:
    """The rows of the window the guardrail chose; none when even that is too small."""
    end = latest(df, ts) if now is None else now
    guard = volume_guardrail(df, hours, fallback, min_rows, end, ts)
    # A null interval keeps no row.
    width = guard.select(
        F.when(
            F.col("status") == "OK", F.make_dt_interval(hours=F.col("window_hours"))
        ).alias("width")
    ).scalar()
    return recent(df, max(hours, fallback), end, ts).where(F.col(ts) >= end - width)
