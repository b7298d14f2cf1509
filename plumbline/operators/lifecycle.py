"""Metric lifecycle: last run, anchored accumulation windows, archive, trends.

A tick is a batch's exact time, or its unit when one is named. The ordered part
of the work sees cells of time with their first and last tick, not the ticks:
each pass narrows the cells that can hold the start of a window until every
start is one tick. Rows are never gathered or sorted by time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.labels import SENTIMENTS
from plumbline.operators.metrics import sentiment_counts, series
from plumbline.plans.small import fitted, written

# Length of an accumulation window and archives kept.
WINDOW_DAYS = 91
DAY_MICROS = 86_400_000_000
ARCHIVES_KEPT = 100
COUNTS = (*SENTIMENTS, "total")
#: Cells of a window's length in the first pass, and parts of a cell in each further pass.
CELLS, PARTS = 4096, 64


def ticked(log: DataFrame, ts: str = "ts", tick: str | None = None) -> DataFrame:
    """The rows that have a time, with their ``tick``: the exact time unless a unit is named."""
    time = F.col(ts) if tick is None else F.date_trunc(tick, ts)
    return log.where(F.col(ts).isNotNull()).withColumn("tick", time)


def tick_counts(log: DataFrame, ts: str = "ts", tick: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by..., tick, negative, neutral, positive, total``."""
    return sentiment_counts(ticked(log, ts, tick), [*by, "tick"])


def _tenant(by: Sequence[str]) -> Column:
    """All columns of a tenant as one key that is never null."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def _cell(micros: str, width: int) -> Column:
    """Where the cell of a time begins."""
    return F.col(micros) - F.pmod(F.col(micros), F.lit(width))


def chain(first: np.ndarray, last: np.ndarray, span: int) -> tuple[list[int], list[int]]:
    """The least and the greatest tick that each start in turn can be.

    Cells come in order, with their first and last tick. A start is the first tick ``span`` or more
    after the one before; cells tell it exactly, or up to the cell that it falls into.
    """
    low, high = [int(first[0])], [int(first[0])]
    while True:
        i, j = np.searchsorted(last, [low[-1] + span, high[-1] + span])
        if i == len(last):
            return low, high
        least = max(low[-1] + span, int(first[i]))
        if j == len(last):
            most = int(last[-1])
        else:
            most = int(first[j]) if first[j] >= high[-1] + span else int(last[j])
        low.append(least)
        high.append(most)


def window_starts(rows: DataFrame, by: Sequence[str] = (), days: int = WINDOW_DAYS) -> DataFrame:
    """``_tenant, start_date, end_date, _start`` of the windows of rows with a ``tick``.

    The first tick opens a window, and so does each first tick ``days`` or more after the last
    start. Elapsed time counts, not calendar days. A window ends where the next one of its tenant
    starts; the open one has no end.

    Ticks collapse to cells of time before any shuffle, and a tenant's cells are read in order.
    Where they leave a start open, the cells it can fall into are parted and read again, down to
    a microsecond at most; the other ticks are out by then.
    """
    span = int(days) * DAY_MICROS
    times = rows.select(_tenant(by).alias("_tenant"), F.unix_micros("tick").alias("_micros"))

    def starts(cells: pd.DataFrame) -> pd.DataFrame:
        ordered = cells.sort_values("_first")
        low, high = chain(ordered["_first"].to_numpy(), ordered["_last"].to_numpy(), span)
        return pd.DataFrame({"_tenant": cells["_tenant"].iloc[0], "_start": low, "_most": high})

    width = max(1, span // CELLS)
    while True:
        cells = times.groupBy("_tenant", _cell("_micros", width).alias("_cell")).agg(
            F.min("_micros").alias("_first"), F.max("_micros").alias("_last")
        )
        narrow = cells.select("_tenant", "_first", "_last").groupBy("_tenant")
        found = written(narrow.applyInPandas(starts, "_tenant string, _start long, _most long"), "starts")
        if found.where(F.col("_start") < F.col("_most")).isEmpty():
            break
        reach = F.explode(F.sequence(_cell("_start", width), F.col("_most"), F.lit(width).cast("long")))
        held = fitted(found.select("_tenant", reach.alias("_cell")).distinct())
        met = times.withColumn("_cell", _cell("_micros", width)).join(held.hinted(), ["_tenant", "_cell"], "left_semi")
        times, width = met.drop("_cell"), max(1, width // PARTS)
    order = Window.partitionBy("_tenant").orderBy("_start")
    return found.select(
        "_tenant",
        F.timestamp_micros("_start").alias("start_date"),
        F.timestamp_micros(F.lead("_start").over(order)).alias("end_date"),
        "_start",
    )


def assign_windows(
    rows: DataFrame, windows: DataFrame, by: Sequence[str] = (), days: int = WINDOW_DAYS
) -> DataFrame:
    """Rows with a ``tick``, with ``start_date`` and ``end_date`` of their window.

    All ticks of a window are less than ``days`` after its start, so it meets two slots of that length.
    """
    span = int(days) * DAY_MICROS
    slot = _cell("_start", span)
    slots = fitted(windows.withColumn("_slot", F.explode(F.array(slot, slot + F.lit(span)))))
    keyed = rows.withColumns({"_tenant": _tenant(by), "_micros": F.unix_micros("tick")})
    met = keyed.withColumn("_slot", _cell("_micros", span)).join(slots.hinted(), ["_tenant", "_slot"])
    inside = (F.col("_micros") >= F.col("_start")) & (F.col("_micros") - F.col("_start") < span)
    return met.where(inside).select(*rows.columns, "start_date", "end_date")


def anchored_windows(
    log: DataFrame, ts: str = "ts", tick: str | None = None, by: Sequence[str] = (), days: int = WINDOW_DAYS
) -> DataFrame:
    """Counts per accumulation window.

    A window opens at the first batch and is closed by the first batch ``days``
    or more later, which opens the next one. It is neither a fixed grid nor a
    session: the anchor moves with the data.
    """
    rows = ticked(log, ts, tick).select(*by, "tick", "sentiment")
    return sentiment_counts(
        assign_windows(rows, window_starts(rows, by, days), by, days), [*by, "start_date", "end_date"]
    )


def archive(windows: DataFrame, by: Sequence[str] = (), keep: int = ARCHIVES_KEPT) -> DataFrame:
    """The closed windows, the newest ``keep`` of them per tenant."""
    newest = Window.partitionBy(*by).orderBy(F.col("end_date").desc())
    return (
        windows.where(F.col("end_date").isNotNull())
        .withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= keep)
        .drop("_age")
    )


def lifecycle_gauges(log: DataFrame, ts: str = "ts", tick: str | None = None, days: int = WINDOW_DAYS) -> list[DataFrame]:
    """The lifecycle's metric series: three views, when the open window began and what it holds."""
    ticks, windows = tick_counts(log, ts, tick), anchored_windows(log, ts, tick, (), days)
    opened, past = accumulation(windows), memory_view(archive(windows))
    return [
        series(_long(last_run(ticks), []), "inference_view", "n", ["sentiment"]),
        series(_long(opened, []), "accumulation_view", "n", ["sentiment"]),
        series(_long(past, ["period"]), "memory_view", "n", ["period", "sentiment"]),
        series(opened, "accumulation_created_at", F.unix_micros("created_at") / F.lit(1e6)),
        series(opened, "accumulation_total", "total"),
    ]


def accumulation(windows: DataFrame) -> DataFrame:
    """The open window; ``created_at`` is its start."""
    return windows.where(F.col("end_date").isNull()).drop("end_date").withColumnRenamed(
        "start_date", "created_at"
    )


def memory_view(archives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Archives by the date they started; the later one of a date replaces the earlier."""
    return (
        archives.withColumn("period", F.date_format("start_date", "yyyy-MM-dd"))
        .groupBy(*by, "period")
        .agg(F.max_by(F.struct(*COUNTS), "end_date").alias("c"))
        .select(*by, "period", "c.*")
    )


def last_run(ticks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the latest tick."""
    return (
        ticks.groupBy(*by)
        .agg(F.max_by(F.struct("tick", *COUNTS), "tick").alias("c"))
        .select(*by, F.date_format("c.tick", "yyyy-MM-dd").alias("period"), *[f"c.{c}" for c in COUNTS])
    )


def lifecycle_views(
    log: DataFrame, ts: str = "ts", tick: str | None = None, by: Sequence[str] = (), days: int = WINDOW_DAYS
) -> DataFrame:
    """``view, by..., period, counts``: last run, open accumulation, archived periods."""
    ticks = tick_counts(log, ts, tick, by)
    windows = anchored_windows(log, ts, tick, by, days)
    opened = accumulation(windows).select(
        *by, F.date_format("created_at", "yyyy-MM-dd").alias("period"), *COUNTS
    )
    parts = {
        "inference": last_run(ticks, by),
        "accumulation": opened,
        "memory": memory_view(archive(windows, by), by),
    }
    named = [df.select(F.lit(view).alias("view"), *by, "period", *COUNTS) for view, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def archived_total(archives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows in all archived periods together."""
    return archives.groupBy(*by).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def _long(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{s}', {s}" for s in SENTIMENTS)
    return df.select(*keep, F.expr(f"stack({len(SENTIMENTS)}, {pairs}) as (sentiment, n)"))


def period_delta(archives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per sentiment, each archived period against the one before it."""
    order = Window.partitionBy(*by, "sentiment").orderBy("start_date")
    before = F.lag("n").over(order)
    return (
        _long(archives, [*by, "start_date"])
        .withColumn("previous", before)
        .withColumn("delta", F.col("n") - F.col("previous"))
        .withColumn(
            "delta_pct",
            F.try_divide(F.col("delta").cast("double"), F.col("previous").cast("double")) * 100,
        )
    )


def running_accumulation(
    log: DataFrame, ts: str = "ts", tick: str | None = None, by: Sequence[str] = (), days: int = WINDOW_DAYS
) -> DataFrame:
    """Running counts per sentiment inside each accumulation window."""
    starts = window_starts(ticked(log, ts, tick), by, days)
    ticks = assign_windows(tick_counts(log, ts, tick, by), starts, by, days)
    order = (
        Window.partitionBy(*by, "start_date", "sentiment")
        .orderBy("tick")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return _long(ticks, [*by, "start_date", "tick"]).withColumn("running", F.sum("n").over(order))


def tumbling_counts(log: DataFrame, ts: str = "ts", days: int = WINDOW_DAYS, by: Sequence[str] = ()) -> DataFrame:
    """Counts on the fixed grid of ``days`` from the epoch."""
    rows = log.withColumn("window_start", F.window(ts, f"{int(days)} days")["start"])
    return sentiment_counts(rows, [*by, "window_start"])


def sliding_counts(
    log: DataFrame, ts: str = "ts", hours: int = 24, slide_hours: int = 1, by: Sequence[str] = ()
) -> DataFrame:
    """Counts in windows of ``hours`` that start every ``slide_hours``.

    Rows are counted per slide first; only those counts are repeated for the
    windows they fall into, not the rows.
    """
    if hours % slide_hours:
        raise ValueError("the slide has to divide the window")
    steps = sentiment_counts(
        log.withColumn("step", F.window(ts, f"{int(slide_hours)} hours")["start"]), [*by, "step"]
    )
    window = F.window("step", f"{int(hours)} hours", f"{int(slide_hours)} hours")
    return (
        steps.withColumn("window_start", window["start"])
        .groupBy(*by, "window_start")
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
    )


def daily_counts(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts per day and sentiment."""
    return log.groupBy(F.date_trunc("day", ts).alias("day"), "sentiment").agg(
        F.count(F.lit(1)).alias("n")
    )
