"""Streams over the prediction log: scoring, counters, drift and lifecycle.

Every function takes a streaming frame and a checkpoint path. ``run_available``
starts a query that reads what is there and stops; a service would start the
same writer with another trigger.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.operators.drift import SIGNALS, Signal, joint_counts, per_signal, psi_of_counts, signal_keys
from plumbline.operators.lifecycle import COUNTS, DAY_MICROS, WINDOW_DAYS
from plumbline.operators.metrics import sentiment_counts
from plumbline.operators.prepare import with_text
from plumbline.operators.scoring import Scorer, predict
from plumbline.session import ROCKSDB_PROVIDER
from plumbline.sources.log import log_rows

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rocksdb(spark: SparkSession) -> None:
    """State of several variables needs the RocksDB store."""
    if spark.conf.get(STATE_PROVIDER) != ROCKSDB_PROVIDER:
        spark.conf.set(STATE_PROVIDER, ROCKSDB_PROVIDER)


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of files arriving under a folder."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    query: StreamingQuery = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# ---------------------------------------------------------------- scoring


def score_stream(uploads: DataFrame, scorers: Mapping[str, Scorer], out_path: str, fmt: str = "json") -> DataStreamWriter:
    """Score arriving uploads and append them to the log.

    The file sink commits each micro-batch once, so a retry does not log twice.
    """
    scored = predict(with_text(uploads), scorers)
    rows = log_rows(scored, F.current_timestamp()).withColumn("log_date", F.to_date("timestamp"))
    return (
        rows.writeStream.format(fmt)
        .option("path", out_path)
        .partitionBy("log_date")
        .outputMode("append")
    )


# ---------------------------------------------------------------- counters


def counters_stream(log: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``day, sentiment, n`` of closed windows; rows later than ``delay`` are dropped.

    The number of dropped rows is in the query's progress as
    ``numRowsDroppedByWatermark``.
    """
    return (
        log.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), "sentiment")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), "sentiment", "n")
    )


# ---------------------------------------------------------------- drift


def drift_counts_stream(
    log: DataFrame,
    baselines: DataFrame,
    signals: Sequence[Signal] = SIGNALS,
    ts: str = "ts",
    width: str = "1 day",
    delay: str = "1 hour",
    model_col: str = "model_used",
) -> DataFrame:
    """``window_start, model, k0, k1, ..., n`` of closed windows: rows by the combination of their bins.

    State holds one counter per window, model and combination that occurs; a row is counted once
    for all signals.
    """
    windowed = log.withWatermark(ts, delay).withColumn("w", F.window(ts, width))
    keyed = signal_keys(windowed, baselines, signals, model_col, ["w"])
    counts = joint_counts(keyed, signals, ["w"])
    return counts.select(F.col("w.start").alias("window_start"), *(c for c in counts.columns if c != "w"))


def drift_stream(
    log: DataFrame,
    baselines: DataFrame,
    out_path: str,
    signals: Sequence[Signal] = SIGNALS,
    ts: str = "ts",
    width: str = "1 day",
    delay: str = "1 hour",
) -> DataStreamWriter:
    """PSI of every closed window, appended per micro-batch.

    A window closes in one micro-batch with all its bins. Each batch writes a
    folder of its own and replaces it when retried.
    """
    counts = drift_counts_stream(log, baselines, signals, ts, width, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the stateful plan runs once, however often the scores read the counts
        try:
            scores = psi_of_counts(per_signal(batch, signals, ["window_start"]), baselines, ["window_start"])
            scores.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return counts.writeStream.outputMode("append").foreachBatch(write)


# ---------------------------------------------------------------- lifecycle

_STATE = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in COUNTS],
        # Microseconds since the epoch: plain numbers do not depend on a worker's time zone.
        T.StructField("created_at", T.LongType()),
    ]
)

ARCHIVED = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("start_date", T.TimestampType()),
        T.StructField("end_date", T.TimestampType()),
        *[T.StructField(c, T.LongType()) for c in COUNTS],
    ]
)


def accumulator(days: int = WINDOW_DAYS) -> StatefulProcessor:
    """Accumulation window of one tenant: five values of state, archives out.

    The class is made here so that it travels to the workers by value.
    """

    class Accumulator(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.window = handle.getValueState("window", _STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            state = self.window.get()
            # One row per tick: the counts were reduced before they came here.
            ticks = pd.concat(list(rows)).sort_values("tick")
            closed = []
            for row in ticks.itertuples(index=False):
                tick = pd.Timestamp(row.tick).value // 1000
                if state is not None and tick - state[-1] >= days * DAY_MICROS:
                    span = [pd.Timestamp(t, unit="us") for t in (state[-1], tick)]
                    closed.append((key[0], *span, *state[:-1]))
                    state = None
                counts = [int(getattr(row, c)) for c in COUNTS]
                if state is None:
                    state = (*counts, tick)
                else:
                    state = (*[a + b for a, b in zip(state[:-1], counts)], state[-1])
            if state is not None:
                self.window.update(tuple(state))
            yield pd.DataFrame(closed, columns=ARCHIVED.names)

        def close(self) -> None:
            pass

    return Accumulator()


def lifecycle_stream(
    log: DataFrame, tenant: str = "tenant", ts: str = "ts", tick: str | None = None, delay: str = "0 seconds",
    days: int = WINDOW_DAYS,
) -> DataFrame:
    """Archived accumulation windows of each tenant.

    Rows are counted per batch time, or per ``tick`` if one is named, before they reach the state,
    so a tenant with a third of all rows sends one row per time. Ticks leave the first step in
    order of the watermark, which is the order the windows need.
    """
    rocksdb(log.sparkSession)
    timed, who = log.withWatermark(ts, delay), F.col(tenant).cast("string").alias("tenant")
    if tick is None:
        ticks = sentiment_counts(timed, [who, F.col(ts)]).select("tenant", F.col(ts).alias("tick"), *COUNTS)
    else:
        windowed = timed.withColumn("w", F.window(ts, tick))
        ticks = sentiment_counts(windowed, [who, "w"]).select("tenant", F.col("w.start").alias("tick"), *COUNTS)
    return ticks.groupBy("tenant").transformWithStateInPandas(
        statefulProcessor=accumulator(days),
        outputStructType=ARCHIVED,
        outputMode="Append",
        timeMode="None",
    )
