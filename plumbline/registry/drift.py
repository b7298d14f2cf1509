"""Binning, PSI, baselines, windows and the drift summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.psi import drift_status, psi, psi_level, risk_pct, with_risk
from plumbline.functions.scores import round_to
from plumbline.functions.text import text_length
from plumbline.operators.binning import (
    categorical_frequency,
    categories,
    counted_quantile_edges,
    equal_width_edges,
    histogram,
    quantile_edges,
    value_counts,
)
from plumbline.operators.drift import (
    DATA,
    PREDICTION,
    SIGNALS,
    TARGET,
    baseline_counts,
    baselines_of_counts,
    build_baselines,
    drift_summary,
    guarded_window,
    production_psi,
    recent,
    volume_guardrail,
)
from plumbline.plans.small import fitted, written
from plumbline.plans.views import event_rows, predictions, table
from plumbline.session import work_path
from plumbline.sources.baselines import add_training_counts, load_training_counts
from plumbline.registry.sql import (
    TS,
    bins_of,
    in_bin,
    level,
    psi_of,
    quantile_edges as sql_quantile_edges,
    risk,
    width_edges,
    with_views,
)

DAY_HOURS = 24
WEEK_HOURS = 168
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", text_length("text").alias("text_length"))


def _edges_long(edges, by):
    return edges.select(*by, F.posexplode("edges").alias("i", "edge")).withColumn("edge", round_to("edge", 6))


def quantile_bins(spark, sf):
    counts = value_counts(lengths(spark, sf), "text_length", ["lang"])
    return _edges_long(counted_quantile_edges(counts, ["lang"]), ["lang"])


def event_value_bins(spark, sf):
    """Quantiles of a column with about as many values as rows."""
    return _edges_long(quantile_edges(table(spark, sf, "events"), "value"), [])


def width_bins(spark, sf):
    edges = equal_width_edges(event_rows(spark, sf), "confidence", ["model_used"])
    return _edges_long(edges, ["model_used"])


BASE = "en"
_BASE_KEY = '{"lang":"en"}'


def _by_language(df):
    """Rows with ``key``, which names their language; a missing one has a name too."""
    return df.withColumn("key", F.to_json(F.struct("lang")))


def _named(df):
    return df.withColumn("lang", F.from_json("key", "lang string")["lang"]).drop("key")


def _length_frames(spark, sf):
    """English lengths as the baseline, those of every other language as production, on one set of edges.

    Texts are read once, for how often each length occurs.
    """
    counts = written(value_counts(_by_language(lengths(spark, sf)), "text_length", ["key"]), "length-counts")
    base, others = counts.where(F.col("key") == _BASE_KEY), counts.where(F.col("key") != _BASE_KEY)
    edges = fitted(counted_quantile_edges(base, ["key"]))
    expected = histogram(base, "x", edges, ["key"], weight="n").drop("key")
    one = fitted(edges.df.select("edges"))
    each = fitted(one.attach(others.select("key").distinct(), [], "edges"))
    return expected, histogram(others, "x", each, ["key"], weight="n")


def histogram_freq(spark, sf):
    _, actual = _length_frames(spark, sf)
    return _named(actual).select(
        "lang", "bin", round_to("lo", 6).alias("lo"), round_to("hi", 6).alias("hi"), "n", round_to("freq", 6).alias("freq")
    )


def psi_numeric(spark, sf):
    """Do people write differently elsewhere? English text lengths against those of every other language."""
    expected, actual = _length_frames(spark, sf)
    bins = actual.select("key", "bin", F.col("freq").alias("actual")).join(
        expected.select("bin", F.col("freq").alias("expected")), "bin"
    )
    scored = _named(psi(bins, ["key"]))
    return scored.select(
        "lang",
        F.lit("text_length").alias("feature"),
        round_to("psi", 6).alias("psi"),
        psi_level("psi").alias("level"),
        risk_pct("psi").alias("risk_pct"),
    )


def _source_frames(spark, sf):
    """Shares of the sources that English documents come from, there and in every other language."""
    counts = _by_language(table(spark, sf, "documents")).groupBy("key", "source").agg(F.count(F.lit(1)).alias("n"))
    counts = fitted(counts).df
    base, others = counts.where(F.col("key") == _BASE_KEY), counts.where(F.col("key") != _BASE_KEY)
    listed = categories(base, "source")
    expected = categorical_frequency(base.drop("key"), "source", listed, weight="n")
    # Every other language is held against the whole list.
    each = F.explode(F.lit([r[0] for r in fitted(listed).df.collect()]).cast("array<string>")).alias("source")
    actual = categorical_frequency(others, "source", others.select("key").distinct().select("key", each), ["key"], weight="n")
    return expected, actual


def categorical_freq(spark, sf):
    _, actual = _source_frames(spark, sf)
    return _named(actual).select("lang", "source", "n", round_to("freq", 6).alias("freq"))


def psi_categorical(spark, sf):
    expected, actual = _source_frames(spark, sf)
    bins = actual.select("key", "source", F.col("freq").alias("actual")).join(
        expected.select("source", F.col("freq").alias("expected")), "source"
    )
    return _named(psi(bins, ["key"])).select("lang", F.lit("source").alias("feature"), round_to("psi", 6).alias("psi"))


def category_rows(spark, sf):
    return categories(table(spark, sf, "documents"), "source")


def _score(df):
    """Event values as made-up PSI values, to run the rules over a whole column."""
    return df.withColumn("psi", F.when(F.col("event_type") != "view", F.col("value") / F.lit(200.0)))


def psi_risks(spark, sf):
    return with_risk(_score(table(spark, sf, "events"))).select("event_id", "psi", "level", "risk_pct")


def statuses(spark, sf):
    events = _score(table(spark, sf, "events"))
    return events.select("event_id", drift_status("psi", F.col("user_id") % 3).alias("status"))


# ---------------------------------------------------------------- baselines and windows


def last_time(log):
    """The end of the log as a literal, so that window filters reach the scan."""
    text = log.agg(F.max("ts").cast("string")).first()[0]
    return F.lit(text).cast("timestamp")


def narrow_log(spark, sf, signals=SIGNALS):
    """The log without its texts.

    Text lengths take a join, and baselines take several passes, so that log is
    written once, a few dozen bytes per row.
    """
    if DATA not in signals:
        return event_rows(spark, sf)
    return written(predictions(spark, sf).drop("text"), "log")


def windows(log):
    """Rows before the last week, and those of the last week."""
    end = last_time(log)
    past = log.where(F.col("ts") < end - F.expr(f"interval {WEEK_HOURS} hours"))
    return past, recent(log, WEEK_HOURS, end)


def _baseline_query(signal):
    def run(spark, sf):
        past, _ = windows(narrow_log(spark, sf, [signal]))
        return build_baselines(past, [signal]).select(
            "model", "bin", round_to("lo", 6).alias("lo"), round_to("hi", 6).alias("hi"), "category",
            round_to("expected", 6).alias("expected"),
        )

    return run


def baseline_merged(spark, sf):
    """Baselines of all signals out of a store to which two halves of the training rows were added apart."""
    past, _ = windows(narrow_log(spark, sf))
    store = work_path(spark, "training-counts")
    for half in (0, 1):
        add_training_counts(baseline_counts(past.where(F.pmod("row_id", F.lit(2)) == half)), store, f"half-{half}")
    return baselines_of_counts(load_training_counts(spark, store)).select(
        "signal", "model", "bin", round_to("lo", 6).alias("lo"), round_to("hi", 6).alias("hi"), "category",
        round_to("expected", 6).alias("expected"),
    )


def _drift_query(signal):
    def run(spark, sf):
        past, week = windows(narrow_log(spark, sf, [signal]))
        scores = production_psi(week, build_baselines(past, [signal]), [signal])
        return scores.select("model", "signal", "feature", round_to("psi", 6).alias("psi"), "rows")

    return run


def summary(spark, sf):
    past, week = windows(narrow_log(spark, sf))
    return drift_summary(week, build_baselines(past))


def recent_window(spark, sf):
    rows = recent(event_rows(spark, sf), DAY_HOURS)
    return rows.select("row_id", F.date_format("ts", TS_FORMAT).alias("ts"), "sentiment", "confidence")


def guardrail(spark, sf):
    return volume_guardrail(event_rows(spark, sf)).select(
        "n_window", "n_fallback", "lookback_expanded", "window_hours", "total_predictions", "status"
    )


def guarded_rows(spark, sf):
    return guarded_window(event_rows(spark, sf)).select("row_id", "sentiment", "model_used")


_LENGTH_CTES = f"""
lens as (select doc_id, lang, length(text) as x from documents),
edges as (select 1 as g, {sql_quantile_edges('x')} as e from lens where lang = 'en'),
bins as ({bins_of('edges', 'g')}),
langs as (select distinct lang from documents where lang is distinct from 'en'),
base as (select bin, lo, hi, count(x) as n from bins left join lens on lang = 'en' and {in_bin('x')} group by all),
now as (
  select l.lang, bin, lo, hi, count(x) as n from langs l cross join bins left join lens d on d.lang is not distinct from l.lang and {in_bin('x')}
  group by all
),
freq as (
  select now.lang, bin, now.lo, now.hi, now.n, base.n::double / sum(base.n) over (partition by now.lang) as expected,
    case when sum(now.n) over (partition by now.lang) = 0 then 0.0001::double / count(*) over (partition by now.lang)
      else now.n::double / sum(now.n) over (partition by now.lang) end as actual
  from now join base using (bin)
)"""

_SOURCE_CTES = """
listed as (select distinct source from documents where lang = 'en' and source is not null),
langs as (select lang, count(source) as total from documents where lang is distinct from 'en' group by lang),
base as (select source, count(*)::double / (select count(source) from documents where lang = 'en') as expected
  from documents join listed using (source) where lang = 'en' group by source),
now as (
  select l.lang, b.source, expected, total, count(d.source) as n from langs l cross join base b
    left join documents d on d.lang is not distinct from l.lang and d.source = b.source group by all
),
freq as (
  select lang, source, n, expected, case when total = 0 then 0.0001::double / count(*) over (partition by lang) else n::double / total end as actual
  from now
)"""


def numeric_ctes(x: str, edges: str, name: str) -> str:
    """Per-model baseline shares and recent shares of a numeric column."""
    return f"""
{name}_edges as (select model_used as model, {edges} as e from v_train group by 1),
{name}_bins as ({bins_of(f'{name}_edges', 'model')}),
{name}_base as (
  select b.model, bin, lo, hi, count(t.row_id) as n from {name}_bins b left join v_train t on t.model_used = b.model and {in_bin('t.' + x)} group by all
),
{name}_expected as (select model, bin, lo, hi, n::double / sum(n) over (partition by model) as expected from {name}_base),
{name}_now as (
  select b.model, bin, count(t.row_id) as n from {name}_bins b left join v_recent t on t.model_used = b.model and {in_bin('t.' + x)} group by all
),
{name}_freq as (
  select model, expected, n::double / sum(n) over (partition by model) as actual, sum(n) over (partition by model) as nrows
  from {name}_expected join {name}_now using (model, bin)
),
{name}_psi as ({psi_of(f'{name}_freq', 'model')})"""


TARGET_CTES = f"""
target_base as (select model_used as model, label, count(*) as n from v_train group by all),
target_expected as (
  select model, cast(row_number() over (partition by model order by label) - 1 as int) as bin, cast(label as varchar) as category,
    n::double / sum(n) over (partition by model) as expected from target_base
),
target_now as (select model_used as model, cast(label as varchar) as category, count(*) as n from v_recent group by all),
target_freq as (
  select e.model, e.expected, coalesce(t.n, 0)::double / (select sum(n) from target_now x where x.model = e.model) as actual,
    (select sum(n) from target_now x where x.model = e.model) as nrows
  from target_expected e left join target_now t using (model, category)
),
target_psi as ({psi_of('target_freq', 'model')})"""

DATA_CTES = numeric_ctes("text_length", sql_quantile_edges("text_length"), "data")
PREDICTION_CTES = numeric_ctes("confidence", width_edges("confidence"), "prediction")


def _drift_sql(name, feature, ctes):
    return with_views(
        ["v_train", "v_recent"],
        f"""select model, '{name}' as signal, '{feature}' as feature, round(psi, 6) as psi, cast(nrows as bigint) as rows
        from {name}_psi join (select distinct model, nrows from {name}_freq) using (model)""",
        ctes,
    )


def _baseline_sql(name, ctes):
    return with_views(
        ["v_train", "v_recent"],
        f"""select model, bin, round(lo, 6) as lo, round(hi, 6) as hi, cast(null as varchar) as category,
        round(expected, 6) as expected from {name}_expected""",
        ctes,
    )


_SUMMARY_SQL = with_views(
    ["v_train", "v_recent"],
    f"""select model, signal, round(psi, 4) as psi, {level('psi')} as level, {risk('psi')} as risk_pct,
      case when n = 0 then 'no_predictions' when psi is null then 'no_baseline' when psi >= 0.25::double then 'ALERT' else 'OK' end as status,
      cast(n as bigint) as n from both_levels""",
    ",".join([DATA_CTES, TARGET_CTES, PREDICTION_CTES])
    + """,
per_model as (
  select model, signal, psi, (select count(*) from v_recent r where r.model_used = model) as n from (
    select model, 'data' as signal, psi from data_psi union all select model, 'target', psi from target_psi
    union all select model, 'prediction', psi from prediction_psi)
),
both_levels as (
  select * from per_model union all select 'ensemble', signal, max(psi), sum(n) from per_model group by signal
)""",
)

_GUARD = """
guard as (
  select count(*) filter (where ts >= (select max(ts) from events) - interval 24 hours) as n_window,
    count(*) filter (where ts >= (select max(ts) from events) - interval 168 hours) as n_fallback
  from events
),
verdict as (
  select *, n_window < 500 as lookback_expanded, cast(case when n_window < 500 then 168 else 24 end as int) as window_hours,
    case when n_window < 500 then n_fallback else n_window end as total_predictions from guard
),
decision as (
  select *, case when total_predictions < 500 then 'INSUFFICIENT_VOLUME_FOR_DRIFT' else 'OK' end as status from verdict
)"""

_MADE_UP = "(select event_id, user_id, case when event_type <> 'view' then value / 200::double end as psi from events)"

ENTRIES = {
    "quantile_bins": (
        quantile_bins,
        f"""select lang, cast(unnest(range(len(e))) as int) as i, round(unnest(e), 6) as edge
        from (select lang, {sql_quantile_edges('length(text)')} as e from documents group by lang)""",
    ),
    "quantile_bins_continuous": (
        event_value_bins,
        f"""select cast(unnest(range(len(e))) as int) as i, round(unnest(e), 6) as edge
        from (select {sql_quantile_edges('value')} as e from events)""",
    ),
    "equal_width_bins": (
        width_bins,
        with_views(
            ["v_predictions"],
            f"""select model_used, cast(unnest(range(len(e))) as int) as i, round(unnest(e), 6) as edge
            from (select model_used, {width_edges('confidence')} as e from v_predictions group by 1)""",
        ),
    ),
    "histogram_freq": (
        histogram_freq,
        "with " + _LENGTH_CTES.strip() + " select lang, bin, round(lo, 6) as lo, round(hi, 6) as hi, n, round(actual, 6) as freq from freq",
    ),
    "categorical_freq": (
        categorical_freq,
        "with " + _SOURCE_CTES.strip() + " select lang, source, n, round(actual, 6) as freq from freq",
    ),
    "psi_numeric": (
        psi_numeric,
        "with " + _LENGTH_CTES.strip() + f", scored as ({psi_of('freq', 'lang')}) "
        f"select lang, 'text_length' as feature, round(psi, 6) as psi, {level('psi')} as level, {risk('psi')} as risk_pct from scored",
    ),
    "psi_categorical": (
        psi_categorical,
        "with " + _SOURCE_CTES.strip() + f", scored as ({psi_of('freq', 'lang')}) "
        "select lang, 'source' as feature, round(psi, 6) as psi from scored",
    ),
    "categories": (category_rows, "select distinct source from documents where source is not null"),
    "psi_risk": (
        psi_risks,
        f"select event_id, round(psi, 4) as psi, {level('psi')} as level, {risk('psi')} as risk_pct from {_MADE_UP}",
    ),
    "drift_status": (
        statuses,
        f"""select event_id, case when user_id % 3 = 0 then 'no_predictions' when psi is null then 'no_baseline'
        when psi >= 0.25::double then 'ALERT' else 'OK' end as status from {_MADE_UP}""",
    ),
    "baseline_data": (_baseline_query(DATA), _baseline_sql("data", DATA_CTES)),
    "baseline_target": (
        _baseline_query(TARGET),
        with_views(
            ["v_train", "v_recent"],
            """select model, bin, cast(null as double) as lo, cast(null as double) as hi, category, round(expected, 6) as expected
            from target_expected""",
            TARGET_CTES,
        ),
    ),
    "baseline_prediction": (_baseline_query(PREDICTION), _baseline_sql("prediction", PREDICTION_CTES)),
    "baseline_merged": (
        baseline_merged,
        with_views(
            ["v_train", "v_recent"],
            " union all ".join(
                [
                    *(
                        f"select '{name}' as signal, model, bin, round(lo, 6) as lo, round(hi, 6) as hi, cast(null as varchar) as category, "
                        f"round(expected, 6) as expected from {name}_expected"
                        for name in ("data", "prediction")
                    ),
                    "select 'target', model, bin, cast(null as double), cast(null as double), category, round(expected, 6) from target_expected",
                ]
            ),
            ",".join([DATA_CTES, TARGET_CTES, PREDICTION_CTES]),
        ),
    ),
    "drift_data": (_drift_query(DATA), _drift_sql("data", "text_length", DATA_CTES)),
    "drift_target": (_drift_query(TARGET), _drift_sql("target", "label", TARGET_CTES)),
    "drift_prediction": (_drift_query(PREDICTION), _drift_sql("prediction", "confidence", PREDICTION_CTES)),
    "drift_summary": (summary, _SUMMARY_SQL),
    "recent_window": (
        recent_window,
        with_views(
            ["v_predictions"],
            f"""select row_id, strftime(ts, {TS}) as ts, sentiment, confidence from v_predictions
            where ts >= (select max(ts) from v_predictions) - interval 24 hours""",
        ),
    ),
    "volume_guardrail": (
        guardrail,
        "with " + _GUARD.strip() + " select n_window, n_fallback, lookback_expanded, window_hours, total_predictions, status from decision",
    ),
    "guarded_window": (
        guarded_rows,
        with_views(
            ["v_predictions"],
            """select row_id, sentiment, model_used from v_predictions, decision
            where status = 'OK' and ts >= (select max(ts) from events) - to_hours(window_hours)""",
            _GUARD,
        ),
    ),
}
