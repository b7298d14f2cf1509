"""Views that a stream keeps current: the open accumulation window, and drift over a rolling window.

Both hold small maps per key in the state store. Rows are counted before they come there, so a key
with a third of all rows sends a few counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.labels import SENTIMENTS
from plumbline.operators.drift import (
    FALLBACK_HOURS,
    INSUFFICIENT,
    MIN_ROWS,
    SIGNALS,
    WINDOW_HOURS,
    Signal,
    joint_counts,
    per_signal,
    psi_of_counts,
    signal_keys,
)
from plumbline.operators.lifecycle import COUNTS, DAY_MICROS, WINDOW_DAYS
from plumbline.plans.small import stored
from plumbline.streaming.queries import rocksdb

HOUR_MICROS = 3_600_000_000


def micros(column: str):
    """Times as plain numbers, which do not depend on a worker's time zone."""
    return F.unix_micros(column)


# ---------------------------------------------------------------- open windows

WINDOW_STATE = T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, "created_at")])
TICK_COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
VIEW = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("closed", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("created_at", "as_of", *COUNTS)],
    ]
)


def partial_ticks(log: DataFrame, tenant: str, ts: str, tick: str | None) -> DataFrame:
    """``tenant, tick, counts`` of every Arrow batch: what a task sends instead of its rows."""
    time = F.col(ts) if tick is None else F.date_trunc(tick, ts)
    rows = log.where(F.col(ts).isNotNull()).select(
        F.col(tenant).cast("string").alias("tenant"), time.cast("timestamp").alias("tick"), F.col("sentiment").cast("string").alias("s")
    )
    schema = T.StructType([T.StructField("tenant", T.StringType()), T.StructField("tick", T.TimestampType()), *TICK_COUNTS.fields])

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                columns = {"tenant": batch.column(0), "tick": batch.column(1), "total": pa.array([1] * batch.num_rows, pa.int64())}
                for name in SENTIMENTS:
                    columns[name] = pa.array([x == name for x in batch.column(2).to_pylist()]).cast(pa.int64())
                sums = pa.table(columns).group_by(["tenant", "tick"]).aggregate([(c, "sum") for c in COUNTS])
                sums = sums.select(["tenant", "tick", *(f"{c}_sum" for c in COUNTS)]).rename_columns(["tenant", "tick", *COUNTS])
                yield from sums.combine_chunks().to_batches()

    return rows.mapInArrow(count, schema)


def fold(state: tuple | None, tick: int, counts: Sequence[int], span: int) -> tuple[tuple, tuple | None]:
    """The window after a tick, and the one that the tick has closed."""
    closed = None
    if state is not None and tick - state[-1] >= span:
        closed, state = state, None
    if state is None:
        return (*counts, tick), closed
    return (*(a + b for a, b in zip(state[:-1], counts)), state[-1]), closed


def open_window_processor(days: int) -> StatefulProcessor:
    """The class is made here so that it travels to the workers by value."""

    class OpenWindow(StatefulProcessor):
        """``window``: all ticks that can no longer change. ``pending``: counts of later ticks."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.window = handle.getValueState("window", WINDOW_STATE)
            self.pending = handle.getMapState("pending", T.StructType([T.StructField("tick", T.LongType())]), TICK_COUNTS)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            final = timerValues.getCurrentWatermarkInMs() * 1000
            stored = {int(k[0]): tuple(int(x) for x in v) for k, v in self.pending.iterator()}
            ticks = dict(stored)
            for frame in rows:
                for row in frame.itertuples(index=False):
                    before = ticks.get(int(row.micros), (0,) * len(COUNTS))
                    ticks[int(row.micros)] = tuple(a + int(getattr(row, c)) for a, c in zip(before, COUNTS))
            state, out, span = self.window.get(), [], days * DAY_MICROS
            state = kept = None if state is None else tuple(int(x) for x in state)
            as_of = None if state is None else state[-1]
            for tick in sorted(ticks):
                state, closed = fold(state, tick, ticks[tick], span)
                as_of = tick
                if tick <= final:  # no later row can change it
                    kept = state
                    if closed is not None:
                        out.append((key[0], True, closed[-1], tick, *closed[:-1]))
                    if tick in stored:
                        self.pending.removeKey((tick,))
                elif ticks[tick] != stored.get(tick):
                    self.pending.updateValue((tick,), ticks[tick])
            if kept is not None:
                self.window.update(kept)
            if state is not None:
                out.append((key[0], False, state[-1], as_of, *state[:-1]))
            yield pd.DataFrame(out, columns=VIEW.names)

        def close(self) -> None:
            pass

    return OpenWindow()


def open_window_stream(
    log: DataFrame, tenant: str = "tenant", ts: str = "ts", tick: str | None = None, delay: str = "0 seconds", days: int = WINDOW_DAYS
) -> DataFrame:
    """``tenant, closed, created_at, as_of, counts`` whenever rows of a tenant arrive (update mode).

    The row that is not ``closed`` is the tenant's window as it stands with everything that has
    arrived, ticks that may still change included; it replaces the former one. Windows that the
    watermark has settled come once, as closed, and ``as_of`` is the tick that closed them. Ticks may
    arrive in any order within ``delay``; later ones are dropped by the watermark. Rows without a
    time are skipped, a null tenant is a tenant. Times are microseconds since the epoch. State holds
    one window and the ticks of ``delay`` per tenant.
    """
    rocksdb(log.sparkSession)
    ticks = partial_ticks(log, tenant, ts, tick).withWatermark("tick", delay).withColumn("micros", micros("tick"))
    return ticks.groupBy("tenant").transformWithStateInPandas(
        statefulProcessor=open_window_processor(days), outputStructType=VIEW, outputMode="Update", timeMode="EventTime"
    )


def view_writer(views: DataFrame, out_path: str) -> DataStreamWriter:
    """Appends what has changed, a folder a micro-batch that a retry replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return views.writeStream.outputMode("update").foreachBatch(write)


def read_views(spark, out_path: str) -> tuple[DataFrame, DataFrame]:
    """The open window of each tenant, and all closed ones."""
    schema = T.StructType([*VIEW.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{out_path}/batch=*")
    newest = rows.where("not closed").groupBy("tenant").agg(F.max_by(F.struct("created_at", "as_of", *COUNTS), "batch_id").alias("w"))
    return newest.select("tenant", "w.*"), rows.where("closed").drop("closed", "batch_id")


# ---------------------------------------------------------------- rolling drift

HOUR_VALUE = T.StructType([T.StructField("counts", T.StringType())])
_SUMS = T.StructType([T.StructField("hour", T.LongType()), T.StructField("short", T.StringType()), T.StructField("long", T.StringType())])
ROLLING = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("hour_end", T.LongType()),
        T.StructField("window_hours", T.IntegerType()),
        T.StructField("total_predictions", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("status", "signal", "feature", "key")],
        T.StructField("n", T.LongType()),
    ]
)


def hourly_joint_counts(
    log: DataFrame, baselines: DataFrame, signals: Sequence[Signal], ts: str, delay: str, model_col: str
) -> DataFrame:
    """``w, model, k0, k1, ..., n``: rows by the combination of their bins, so no row is repeated per signal."""
    hourly = log.withWatermark(ts, delay).withColumn("w", F.window(ts, "1 hour"))
    return joint_counts(signal_keys(hourly, baselines, signals, model_col, ["w"]), signals, ["w"])


def rolling_processor(signals: Sequence[Signal], hours: int, fallback: int, min_rows: int) -> StatefulProcessor:
    names = [(s.name, s.column) for s in signals]

    class Rolling(StatefulProcessor):
        """``hours``: counts of each hour that a window can still hold, as one value an hour. ``sums``:
        the counts of both windows at the last hour: an hour is added once and subtracted twice."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.hours = handle.getMapState("hours", T.StructType([T.StructField("hour", T.LongType())]), HOUR_VALUE)
            self.sums = handle.getValueState("sums", _SUMS)

        def hour(self, at: int) -> dict:
            return json.loads(self.hours.getValue((at,))[0]) if self.hours.containsKey((at,)) else {}

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            arrived: dict[int, dict[str, int]] = {}
            for frame in rows:
                for row in frame.itertuples(index=False):
                    counts = arrived.setdefault(int(row.hour), {})
                    counts["rows"] = counts.get("rows", 0) + int(row.n)
                    for i in range(len(names)):
                        k = getattr(row, f"k{i}")
                        if k is not None and k == k:
                            counts[f"{i}:{k}"] = counts.get(f"{i}:{k}", 0) + int(row.n)
            held = self.sums.get()
            now, short, long = (None, {}, {}) if held is None else (int(held[0]), json.loads(held[1]), json.loads(held[2]))
            out = []
            for hour in sorted(arrived):
                if now is not None and hour <= now:
                    continue  # an hour comes once: the step before emits it when it is closed
                self.hours.updateValue((hour,), (json.dumps(arrived[hour]),))
                first = hour if now is None else now + HOUR_MICROS
                for at in range(first, hour + 1, HOUR_MICROS):
                    add(short, arrived.get(at, {}), 1)
                    add(long, arrived.get(at, {}), 1)
                    for sums, span in ((short, hours), (long, fallback)):
                        add(sums, self.hour(at - span * HOUR_MICROS), -1)
                    gone = (at - max(hours, fallback) * HOUR_MICROS,)
                    if self.hours.containsKey(gone):
                        self.hours.removeKey(gone)
                    out += report(key[0], at + HOUR_MICROS, short, long)
                now = hour
            if now is not None:
                self.sums.update((now, json.dumps(short), json.dumps(long)))
            yield pd.DataFrame(out, columns=ROLLING.names)

        def close(self) -> None:
            pass

    def add(sums: dict, counts: dict, sign: int) -> None:
        for k, n in counts.items():
            left = sums.get(k, 0) + sign * n
            if left:
                sums[k] = left
            else:
                sums.pop(k, None)

    def report(model, hour_end, short, long) -> list[tuple]:
        wide = short.get("rows", 0) < min_rows
        sums = long if wide else short
        rows = sums.get("rows", 0)
        if not rows:
            return []
        status = INSUFFICIENT if rows < min_rows else "OK"
        head = (model, hour_end, fallback if wide else hours, rows, status)
        # Every signal is named, so that one without a key still has a total of zero.
        out = [(*head, *name, None, 0) for name in names]
        for k, n in sums.items():
            if k != "rows":
                i, own = k.split(":", 1)
                out.append((*head, *names[int(i)], own, n))
        return out

    return Rolling()


def rolling_counts_stream(
    log: DataFrame,
    baselines: DataFrame,
    signals: Sequence[Signal] = SIGNALS,
    ts: str = "ts",
    delay: str = "1 hour",
    model_col: str = "model_used",
    hours: int = WINDOW_HOURS,
    fallback: int = FALLBACK_HOURS,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Bin counts of each model's trailing window, at the end of every hour up to its last closed one.

    The window is ``hours`` long, or ``fallback`` where that holds fewer than ``min_rows`` rows of the
    model; ``status`` says whether it is enough then. Hours without rows are reported too while the
    window holds any. State per model: the counts of at most ``fallback`` hours and two sums. Rows
    later than ``delay`` are dropped by the watermark; rows without a model are a model, a null or
    unlisted value counts as a row without a bin.
    """
    if fallback < hours:
        raise ValueError("the fallback is the longer window")
    rocksdb(log.sparkSession)
    joint = hourly_joint_counts(log, baselines, signals, ts, delay, model_col)
    keys = [f"k{i}" for i in range(len(signals))]
    flat = joint.select("model", F.unix_micros("w.start").alias("hour"), *keys, "n")
    return flat.groupBy("model").transformWithStateInPandas(
        statefulProcessor=rolling_processor(signals, hours, fallback, min_rows),
        outputStructType=ROLLING,
        outputMode="Append",
        timeMode="None",
    )


def rolling_psi(counts: DataFrame, baselines: DataFrame) -> DataFrame:
    """``hour_end, window_hours, total_predictions, status, model, signal, feature, psi, rows`` of rolling counts.

    A window that is too small has no score.
    """
    extra = ["hour_end", "window_hours", "total_predictions", "status"]
    scores = psi_of_counts(counts, baselines, extra)
    return scores.withColumn("psi", F.when(F.col("status") != INSUFFICIENT, F.col("psi")))


def rolling_drift_writer(counts: DataFrame, baselines: DataFrame, out_path: str) -> DataStreamWriter:
    """Scores of every hour, a folder a micro-batch that a retry replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the stateful plan runs once, however often the scores read the counts
        try:
            rolling_psi(batch, baselines).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return counts.writeStream.outputMode("append").foreachBatch(write)


def rolling_drift(
    log: DataFrame,
    baselines: DataFrame,
    signals: Sequence[Signal] = SIGNALS,
    ts: str = "ts",
    model_col: str = "model_used",
    hours: int = WINDOW_HOURS,
    fallback: int = FALLBACK_HOURS,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The same scores of a whole log, in batch: rows are counted per hour once, windows are sums of those counts."""
    timed = log.where(F.col(ts).isNotNull()).withColumn("hour", F.floor(F.unix_micros(ts) / F.lit(HOUR_MICROS)).cast("long"))
    joint = stored(joint_counts(signal_keys(timed, baselines, signals, model_col, ["hour"]), signals, ["hour"]), "hourly-counts")
    per_bin = per_signal(joint, signals, ["hour"]).withColumnRenamed("n", "bin_n")
    volume = joint.groupBy("model", "hour").agg(F.sum("n").alias("n"))
    span = volume.groupBy("model").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    every = span.select("model", F.explode(F.sequence("a", "b")).alias("hour"))
    by_range = lambda by, h: Window.partitionBy(*by).orderBy("hour").rangeBetween(1 - h, 0)
    rows = every.join(volume, ["model", "hour"], "left")
    sums = {f"w{h}": F.coalesce(F.sum("n").over(by_range(["model"], h)), F.lit(0)) for h in (hours, fallback)}
    guard = rows.withColumns(sums).withColumn("wide", F.col(f"w{hours}") < min_rows)
    total = F.when(F.col("wide"), F.col(f"w{fallback}")).otherwise(F.col(f"w{hours}"))
    guard = guard.select("model", "hour", F.when(F.col("wide"), fallback).otherwise(hours).alias("window_hours"), total.alias("total_predictions"))
    guard = guard.where("total_predictions > 0").withColumn(
        "status", F.when(F.col("total_predictions") < min_rows, INSUFFICIENT).otherwise("OK")
    )
    # A bin's hourly count is repeated for the hours whose window can hold it: counts, not rows.
    same = (F.col("g.hour") >= F.col("b.hour")) & F.col("g.model").eqNullSafe(F.col("b.model")) & (F.col("g.hour") < F.col("b.until"))
    held = per_bin.withColumn("until", F.col("hour") + fallback)
    counts = guard.alias("g").join(held.alias("b"), same).where("g.hour < b.hour + g.window_hours")
    counts = counts.groupBy("g.hour", "g.model", "window_hours", "total_predictions", "status", "signal", "feature", "key").agg(F.sum("bin_n").alias("n"))
    counts = counts.withColumn("hour_end", (F.col("hour") + 1) * F.lit(HOUR_MICROS)).drop("hour")
    return rolling_psi(counts, baselines)
