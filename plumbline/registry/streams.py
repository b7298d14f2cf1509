"""Streams over the given tables, run until everything that is there is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scores import round_to
from plumbline.operators.drift import PREDICTION, TARGET, build_baselines
from plumbline.plans.views import event_rows, table
from plumbline.registry.lifecycle import _anchored
from plumbline.registry.sql import psi_of, with_views
from plumbline.session import prepare, work_path
from plumbline.streaming.queries import (
    counters_stream,
    drift_stream,
    lifecycle_stream,
    read_files,
    run_available,
)

from plumbline.streaming.windows import (
    open_window_stream,
    read_views,
    rolling_counts_stream,
    rolling_drift,
    rolling_drift_writer,
    view_writer,
)

DATE = "yyyy-MM-dd"
SIGNALS = [TARGET, PREDICTION]


def stream_of(spark, sf, name):
    """A given table as a stream of files."""
    schema = prepare(spark).read.parquet(f"{sf}/{name}.parquet").schema
    return read_files(spark, sf, schema, pathGlobFilter=f"{name}.parquet")


def log_stream(spark, sf):
    """Events as a streaming log."""
    kind = F.col("event_type")
    sentiment = (
        F.when(kind == "error", "negative").when(kind.isin("view", "click"), "neutral").otherwise("positive")
    )
    value = F.col("value")
    return (
        stream_of(spark, sf, "events")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("sentiment", sentiment)
        .select(
            "ts",
            "sentiment",
            F.when(sentiment == "negative", 0).when(sentiment == "neutral", 1).otherwise(2).alias("label"),
            round_to(F.lit(0.34) + F.lit(0.66) * value / (value + F.lit(50.0)), 4).alias("confidence"),
            F.when(F.col("user_id") % 2 == 0, "social").otherwise("reviews").alias("model_used"),
        )
    )


def _sink(spark, df, name):
    """Run a stream into a folder of the work area and read the folder."""
    out = work_path(spark, name)
    writer = df.writeStream.format("parquet").option("path", f"{out}/data").outputMode("append")
    run_available(writer, f"{out}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def stream_daily(spark, sf):
    rows = _sink(spark, counters_stream(log_stream(spark, sf)), "counters")
    return rows.withColumn("day", F.date_format("day", DATE))


def stream_drift(spark, sf):
    baselines = build_baselines(event_rows(spark, sf), SIGNALS)
    out = work_path(spark, "drift")
    run_available(drift_stream(log_stream(spark, sf), baselines, f"{out}/data", SIGNALS), f"{out}/checkpoint")
    schema = "window_start timestamp, model string, signal string, feature string, rows long, psi double"
    rows = spark.read.schema(schema).parquet(f"{out}/data/batch=*")
    return rows.select(
        F.date_format("window_start", DATE).alias("day"), "model", "signal", round_to("psi", 6).alias("psi"), "rows"
    )


def order_stream(spark, sf):
    """Orders as a streaming log of three tenants."""
    status = F.col("o_orderstatus")
    return stream_of(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(status == "F", "negative").when(status == "O", "neutral").otherwise("positive").alias("sentiment"),
        F.pmod("o_custkey", F.lit(3)).cast("string").alias("tenant"),
    )


def stream_lifecycle(spark, sf):
    rows = _sink(spark, lifecycle_stream(order_stream(spark, sf), tick="1 day"), "lifecycle")
    return rows.withColumns({c: F.date_format(c, DATE) for c in ("start_date", "end_date")})


def stream_open_window(spark, sf):
    """Each tenant's open window as it stands after the last micro-batch."""
    out = work_path(spark, "open-windows")
    views = open_window_stream(order_stream(spark, sf), tick="day")
    run_available(view_writer(views, f"{out}/data"), f"{out}/checkpoint")
    rows, _ = read_views(spark, f"{out}/data")
    return rows.select(
        "tenant", F.date_format(F.timestamp_micros("created_at"), DATE).alias("period"), "negative", "neutral", "positive", "total"
    )


def stream_rolling_drift(spark, sf):
    """Drift of each model over its trailing 24 hours, or 168 where these hold fewer than 500 rows, hour by hour."""
    baselines = build_baselines(event_rows(spark, sf), SIGNALS)
    out = work_path(spark, "rolling-drift")
    counts = rolling_counts_stream(log_stream(spark, sf), baselines, SIGNALS)
    run_available(rolling_drift_writer(counts, baselines, f"{out}/data"), f"{out}/checkpoint")
    schema = "hour_end long, window_hours int, total_predictions long, status string, model string, signal string, psi double, rows long"
    return _hourly(spark.read.schema(schema).parquet(f"{out}/data/batch=*"))


def rolling(spark, sf):
    """The same over the whole log, in batch."""
    log = event_rows(spark, sf)
    return _hourly(rolling_drift(log, build_baselines(log, SIGNALS), SIGNALS))


def _hourly(rows):
    return rows.select(
        F.date_format(F.timestamp_micros("hour_end"), "yyyy-MM-dd HH").alias("hour_end"), "window_hours", "total_predictions",
        "status", "model", "signal", round_to("psi", 6).alias("psi"), "rows",
    )


_CLOSED = "day + interval 1 day <= (select max(ts) from v_predictions) - interval 1 hour"

_BINS = """
edges as (select model_used as model, list_sort(list_distinct(list_transform(range(11), lambda i:
  case when i = 10 then max_c else min_c + i::double * ((max_c - min_c) / 10::double) end))) as e
  from (select model_used, min(confidence) as min_c, max(confidence) as max_c from v_predictions group by 1)),
bins as (select model, bin, e[bin + 1] as lo, e[bin + 2] as hi, bin = len(e) - 2 as closes
  from (select model, e, cast(unnest(range(len(e) - 1)) as int) as bin from edges)),
days as (select date_trunc('day', ts) as day, model_used as model, label, confidence from v_predictions),
binned as (
  select d.day, d.model, 'prediction' as signal, cast(b.bin as varchar) as key from days d
    join bins b on b.model = d.model and d.confidence >= lo and (d.confidence < hi or (closes and d.confidence = hi))
  union all select day, model, 'target', cast(label as varchar) from days
),
base as (select model, signal, key, count(*) as n from binned group by all),
listed as (
  select model, 'prediction' as signal, cast(bin as varchar) as key from bins
  union all select distinct model, signal, key from base where signal = 'target'
),
expected as (
  select l.model, l.signal, l.key, coalesce(b.n, 0)::double / sum(coalesce(b.n, 0)) over (partition by l.model, l.signal) as expected
  from listed l left join base b using (model, signal, key)
),
per_day as (select day, model, signal, key, count(*) as n from binned group by all),
totals as (select day, model, signal, sum(n) as rows from per_day group by all),
freq as (
  select t.day, e.model, e.signal, e.expected, coalesce(p.n, 0)::double / t.rows as actual
  from totals t join expected e using (model, signal) left join per_day p using (day, model, signal, key)
)"""

_HOURS = "hours as (select date_trunc('hour', ts) as hour, * from v_predictions)"
_CLOSED_HOURS = _HOURS[:-1] + """
  where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from v_predictions) - interval 1 hour)"""
_ROLLING = """
joint as (select hour, model_used as model, label, confidence, count(*) as n from hours group by all),
keyed as (
  select hour, j.model, 'prediction' as signal, cast(b.bin as varchar) as key, n from joint j
    join bins b on b.model = j.model and j.confidence >= lo and (j.confidence < hi or (closes and j.confidence = hi))
  union all select hour, model, 'target', cast(label as varchar), n from joint
),
hourly as (select hour, model, signal, key, sum(n) as n from keyed group by all),
volume as (select model, hour, sum(n) as n from joint group by all),
every as (select model, unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from volume group by model),
sums as (
  select e.model, e.hour,
    coalesce(sum(n) filter (where v.hour > e.hour - interval 24 hours), 0) as n24, coalesce(sum(n), 0) as n168
  from every e left join volume v on v.model = e.model and v.hour <= e.hour and v.hour > e.hour - interval 168 hours group by all),
guard as (
  select model, hour, case when n24 < 500 then 168 else 24 end as window_hours, case when n24 < 500 then n168 else n24 end as total
  from sums where n168 > 0),
inside as (
  select g.model, g.hour, h.signal, h.key, sum(h.n) as n from guard g
    join hourly h on h.model = g.model and h.hour <= g.hour and h.hour > g.hour - to_hours(window_hours) group by all),
rolling_totals as (select model, hour, signal, sum(n) as rows from inside group by all),
rolling as (
  select t.hour, e.model, e.signal, e.expected, coalesce(i.n, 0)::double / t.rows as actual
  from rolling_totals t join expected e using (model, signal) left join inside i using (hour, model, signal, key)
)"""

_ROLLING_ROWS = """select strftime(hour + interval 1 hour, '%Y-%m-%d %H') as hour_end, cast(window_hours as int) as window_hours,
              cast(total as bigint) as total_predictions, case when total < 500 then 'INSUFFICIENT_VOLUME_FOR_DRIFT' else 'OK' end as status,
              model, signal, case when total < 500 then null else round(psi, 6) end as psi, cast(rows as bigint) as rows
            from scored join rolling_totals using (hour, model, signal) join guard using (model, hour)"""

ENTRIES = {
    "stream_open_window": (
        stream_open_window,
        with_views(
            ["v_orders"],
            """select tenant, strftime(start_date, '%Y-%m-%d') as period, negative, neutral, positive, total
            from windows where end_date is null""",
            _anchored("tenant"),
            recursive=True,
        ),
    ),
    "stream_rolling_drift": (
        stream_rolling_drift,
        with_views(
            ["v_predictions"],
            _ROLLING_ROWS,
            f"{_BINS}, {_CLOSED_HOURS}, {_ROLLING}, scored as ({psi_of('rolling', 'hour, model, signal')})",
        ),
    ),
    "rolling_drift": (
        rolling,
        with_views(["v_predictions"], _ROLLING_ROWS, f"{_BINS}, {_HOURS}, {_ROLLING}, scored as ({psi_of('rolling', 'hour, model, signal')})"),
    ),
    "stream_daily_counts": (
        stream_daily,
        with_views(
            ["v_predictions"],
            f"""select strftime(day, '%Y-%m-%d') as day, sentiment, n from (
              select date_trunc('day', ts) as day, sentiment, count(*) as n from v_predictions group by all) where {_CLOSED}""",
        ),
    ),
    "stream_drift": (
        stream_drift,
        with_views(
            ["v_predictions"],
            f"""select strftime(day, '%Y-%m-%d') as day, model, signal, round(psi, 6) as psi, cast(rows as bigint) as rows
            from scored join totals using (day, model, signal) where {_CLOSED}""",
            _BINS + f", scored as ({psi_of('freq', 'day, model, signal')})",
        ),
    ),
    "stream_anchored_91d": (
        stream_lifecycle,
        with_views(
            ["v_orders"],
            """select tenant, strftime(start_date, '%Y-%m-%d') as start_date, strftime(end_date, '%Y-%m-%d') as end_date,
              negative, neutral, positive, total
            from windows where end_date is not null and end_date + interval 1 day <= (select max(ts) from v_orders)""",
            _anchored("tenant"),
            recursive=True,
        ),
    ),
}
