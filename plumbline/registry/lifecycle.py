"""Accumulation windows, archive, trends and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scores import round_to
from plumbline.operators.lifecycle import (
    COUNTS,
    anchored_windows,
    archive,
    archived_total,
    daily_counts,
    lifecycle_views,
    period_delta,
    running_accumulation,
    sliding_counts,
    tumbling_counts,
)
from plumbline.plans.views import event_rows, order_log
from plumbline.registry.sql import TS, counts_by, with_views

DATE = "yyyy-MM-dd"
HOUR = "yyyy-MM-dd HH:mm:ss"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _dates(df, *columns, fmt=DATE):
    return df.withColumns({c: F.date_format(c, fmt) for c in columns})


def anchored(spark, sf):
    return _dates(anchored_windows(order_log(spark, sf)), "start_date", "end_date")


def anchored_tenants(spark, sf):
    return _dates(anchored_windows(order_log(spark, sf), by=["tenant"]), "start_date", "end_date")


def anchored_exact(spark, sf):
    """Windows of three days over times with microseconds: elapsed time decides, not the calendar."""
    return _dates(anchored_windows(event_rows(spark, sf), days=3), "start_date", "end_date", fmt=MICROS)


def archives(spark, sf):
    return _dates(archive(anchored_windows(order_log(spark, sf))), "start_date", "end_date")


def archives_total(spark, sf):
    return archived_total(archive(anchored_windows(order_log(spark, sf))))


def views(spark, sf):
    return lifecycle_views(order_log(spark, sf))


def deltas(spark, sf):
    out = _dates(period_delta(archive(anchored_windows(order_log(spark, sf)))), "start_date")
    return out.withColumn("delta_pct", round_to("delta_pct", 6))


def running(spark, sf):
    return _dates(running_accumulation(order_log(spark, sf)), "start_date", "tick")


def tumbling(spark, sf):
    return _dates(tumbling_counts(order_log(spark, sf)), "window_start")


def sliding(spark, sf):
    return _dates(sliding_counts(event_rows(spark, sf)), "window_start", fmt=HOUR)


def daily(spark, sf):
    return _dates(daily_counts(event_rows(spark, sf)), "day")


def _anchored(by: str = "") -> str:
    """Recursive chain of window starts, then the rows between neighbouring starts."""
    part = f"{by}, " if by else ""
    same = f"and o.{by} = w.{by}" if by else ""
    group = f"group by {by}" if by else ""
    over = f"partition by {by} " if by else ""
    return f"""
starts as (
  select {part}min(ts) as s from v_orders {group}
  union all
  select {('w.' + by + ', ') if by else ''}(select min(o.ts) from v_orders o where o.ts >= w.s + interval 91 days {same}) as s
  from starts w where w.s is not null
),
spans as (
  select {part}s as start_date, lead(s) over ({over}order by s) as end_date from starts where s is not null
),
windows as (
  select {('p.' + by + ', ') if by else ''}start_date, end_date, {counts_by('o.')}
  from spans p join v_orders o on o.ts >= start_date and (end_date is null or o.ts < end_date) {f'and o.{by} = p.{by}' if by else ''}
  group by all
),
archived as (select * from windows where end_date is not null order by end_date desc limit 100)"""


_D = "'%Y-%m-%d'"
_C = ", ".join(COUNTS)
_LONG = " union all ".join(
    f"select start_date, '{s}' as sentiment, {s} as n from {{src}}" for s in ("negative", "neutral", "positive")
)


def _sql(body: str, by: str = "") -> str:
    return with_views(["v_orders"], body, _anchored(by), recursive=True)


_START_END = f"strftime(start_date, {_D}) as start_date, strftime(end_date, {_D}) as end_date, {_C}"

_EVENTS = """
ev as (
  select ts, case event_type when 'error' then 'negative' when 'view' then 'neutral' when 'click' then 'neutral'
    else 'positive' end as sentiment from events
),
starts as (
  select min(ts) as s from ev
  union all
  select (select min(ts) from ev where ts >= s + interval 3 days) from starts where s is not null
),
spans as (select s as start_date, lead(s) over (order by s) as end_date from starts where s is not null)"""

ENTRIES = {
    "anchored_exact": (
        anchored_exact,
        with_views(
            [],
            f"""select strftime(start_date, {TS}) as start_date, strftime(end_date, {TS}) as end_date, {counts_by()}
            from spans join ev on ts >= start_date and (end_date is null or ts < end_date) group by start_date, end_date""",
            _EVENTS,
            recursive=True,
        ),
    ),
    "anchored_91d": (anchored, _sql(f"select {_START_END} from windows")),
    "anchored_91d_tenants": (anchored_tenants, _sql(f"select tenant, {_START_END} from windows", "tenant")),
    "archive_periods": (archives, _sql(f"select {_START_END} from archived")),
    "archived_total": (archives_total, _sql("select cast(sum(total) as bigint) as total from archived")),
    "lifecycle_views": (
        views,
        _sql(
            f"""select 'inference' as view, strftime(ts, {_D}) as period, {counts_by()} from v_orders
              where ts = (select max(ts) from v_orders) group by ts
            union all select 'accumulation', strftime(start_date, {_D}), {_C} from windows where end_date is null
            union all select 'memory', strftime(start_date, {_D}), {_C} from archived"""
        ),
    ),
    "period_delta": (
        deltas,
        _sql(
            f"""select strftime(start_date, {_D}) as start_date, sentiment, n, previous, n - previous as delta,
              round((n - previous)::double / nullif(previous, 0)::double * 100, 6) as delta_pct
            from (select *, lag(n) over (partition by sentiment order by start_date) as previous from ({_LONG.format(src='archived')}))"""
        ),
    ),
    "running_accumulation": (
        running,
        _sql(
            f"""select strftime(start_date, {_D}) as start_date, strftime(tick, {_D}) as tick, sentiment, n,
              cast(sum(n) over (partition by start_date, sentiment order by tick) as bigint) as running
            from (select start_date, tick, s.sentiment, count(o.row_id) as n
                  from (select distinct start_date, ts as tick from spans join v_orders on ts >= start_date and (end_date is null or ts < end_date)) t
                  cross join (select unnest(['negative', 'neutral', 'positive']) as sentiment) s
                  left join v_orders o on o.ts = t.tick and o.sentiment = s.sentiment group by all)"""
        ),
    ),
    "tumbling_91d": (
        tumbling,
        with_views(
            ["v_orders"],
            f"""select strftime(w, {_D}) as window_start, {counts_by()} from (
              select *, time_bucket(interval 91 days, ts, timestamp '1970-01-01') as w from v_orders) group by w""",
        ),
    ),
    "sliding_sentiment": (
        sliding,
        with_views(
            ["v_predictions"],
            f"""select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, {counts_by()} from (
              select *, date_trunc('hour', ts) - to_hours(unnest(range(24))) as w from v_predictions) group by w""",
        ),
    ),
    "daily_sentiment": (
        daily,
        with_views(
            ["v_predictions"],
            f"select strftime(ts, {_D}) as day, sentiment, count(*) as n from v_predictions group by all",
        ),
    ),
}
