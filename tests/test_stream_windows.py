from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators.drift import PREDICTION, TARGET, build_baselines, production_psi, recent, volume_guardrail
from plumbline.operators.lifecycle import accumulation, anchored_windows, archive
from plumbline.streaming.queries import read_files, run_available
from plumbline.streaming.windows import (
    fold,
    open_window_stream,
    read_views,
    rolling_counts_stream,
    rolling_drift,
    rolling_drift_writer,
    view_writer,
)
from test_streams import LOG, START, put, rows

SIGNALS = [TARGET, PREDICTION]
COUNTS = ["negative", "neutral", "positive", "total"]


def same(got, want):
    got, want = (sorted(map(tuple, df.collect()), key=str) for df in (got, want))
    assert got == want


def open_windows(spark, tmp_path, delay="2 days"):
    stream = open_window_stream(read_files(spark, str(tmp_path / "in"), LOG), tick="day", delay=delay, days=3)
    run_available(view_writer(stream, str(tmp_path / "out")), str(tmp_path / "cp"))
    return read_views(spark, str(tmp_path / "out"))


def by_batch(spark, data):
    log = spark.createDataFrame(data, LOG).withColumn("tenant", F.col("tenant"))
    windows = anchored_windows(log, tick="day", by=["tenant"], days=3)
    opened = accumulation(windows).select("tenant", F.unix_micros("created_at").alias("created_at"), *COUNTS)
    closed = archive(windows, ["tenant"]).select("tenant", F.unix_micros("start_date").alias("created_at"), F.unix_micros("end_date").alias("as_of"), *COUNTS)
    return opened, closed


def test_fold_closes_by_elapsed_time():
    state, closed = fold(None, 10, (1, 0, 0, 1), 5)
    assert (state, closed) == ((1, 0, 0, 1, 10), None)
    assert fold(state, 14, (0, 1, 0, 1), 5) == ((1, 1, 0, 2, 10), None)
    assert fold(state, 15, (0, 1, 0, 1), 5) == ((0, 1, 0, 1, 15), state)


def test_open_windows_follow_every_batch(spark, tmp_path):
    """Rows out of order within the delay, over three runs of the stream."""
    first, second, third = rows(200, (0, 6), 1), rows(150, (5, 9), 2), rows(80, (8, 20), 3)
    seen = []
    for data in (first, second, third):
        put(spark, data, tmp_path / "in")
        seen += data
        opened, closed = open_windows(spark, tmp_path)
        want_open, want_closed = by_batch(spark, seen)
        same(opened.select("tenant", "created_at", *COUNTS), want_open)
        assert {tuple(r) for r in closed.collect()} <= {tuple(r) for r in want_closed.collect()}
    put(spark, rows(40, (30, 31), 4), tmp_path / "in")
    open_windows(spark, tmp_path)
    put(spark, rows(40, (31, 32), 5), tmp_path / "in")
    _, closed = open_windows(spark, tmp_path)
    # The watermark has passed all earlier ticks: their windows are settled.
    assert len({tuple(r)[:2] for r in closed.collect()}) == closed.count() > 10


def test_open_windows_drop_what_is_too_late(spark, tmp_path):
    put(spark, rows(100, (0, 2), 1), tmp_path / "in")
    put(spark, rows(100, (20, 21), 2), tmp_path / "in")
    open_windows(spark, tmp_path)
    before = sorted(map(tuple, open_windows(spark, tmp_path)[0].select("tenant", "created_at", *COUNTS).collect()))
    put(spark, rows(100, (0, 1), 3), tmp_path / "in")
    assert sorted(map(tuple, open_windows(spark, tmp_path)[0].select("tenant", "created_at", *COUNTS).collect())) == before


def test_open_windows_of_odd_rows(spark, tmp_path):
    data = [(START, "positive", None, "social", 2, 0.5), (None, "neutral", "a", "social", 1, 0.5), (START, None, "a", "social", 1, 0.5),
            (START, "odd", "a", "social", 1, 0.5)] + [(START, "negative", "hot", "social", 0, 0.5)] * 3_000
    put(spark, data, tmp_path / "in")
    opened, closed = open_windows(spark, tmp_path)
    got = {r.tenant: (r.negative, r.neutral, r.positive, r.total) for r in opened.collect()}
    assert got[None] == (0, 0, 1, 1) and got["hot"] == (3_000, 0, 0, 3_000) and got["a"][3] == 2
    assert closed.isEmpty()


@pytest.mark.parametrize("min_rows", [1, 60])
def test_rolling_drift_of_the_stream_equals_batch_windows(spark, tmp_path, min_rows):
    early, late = rows(500, (0, 4), 1), rows(300, (3, 8), 2)
    spans = {"hours": 6, "fallback": 30, "min_rows": min_rows}
    baselines = build_baselines(spark.createDataFrame(early, LOG), SIGNALS)
    out, source = str(tmp_path / "out"), tmp_path / "in"
    first, second = sorted(early + late)[:500], sorted(early + late)[500:]
    for data in (first, second):
        put(spark, data, source)
        counts = rolling_counts_stream(read_files(spark, str(source), LOG), baselines, SIGNALS, **spans)
        run_available(rolling_drift_writer(counts, baselines, out), str(tmp_path / "cp"))
    log = spark.createDataFrame(early + late, LOG)
    names = ["hour_end", "model", "signal", "feature", "window_hours", "total_predictions", "status", "rows", "psi"]
    key = lambda r: tuple(r)[:8]
    got = {key(r): r.psi for r in spark.read.parquet(f"{out}/batch=*").select(*names).collect()}
    closed = int((max(r[0] for r in early + late) - timedelta(hours=1) - START).total_seconds() // 3600)
    settled = log.where(F.col("ts") < F.lit(START + timedelta(hours=closed)))
    want = {key(r): r.psi for r in rolling_drift(settled, baselines, SIGNALS, **spans).select(*names).collect()}
    assert got.keys() == want.keys()
    assert all((p is None) == (want[k] is None) and (p is None or abs(p - want[k]) < 1e-9) for k, p in got.items())
    # One hour against the plain window of that hour.
    hour, model = 100, "social"
    end = F.lit(START + timedelta(hours=hour))
    mine = log.where((F.col("ts") < end) & (F.col("model_used") == model))
    guard = volume_guardrail(mine, spans["hours"], spans["fallback"], min_rows, end).first()
    inside = recent(mine, guard.window_hours, end)
    plain = {r.signal: r.psi for r in production_psi(inside, baselines, SIGNALS).collect()}
    at = {k[2]: (k[4], k[5], p) for k, p in want.items() if k[0] == (int(START.timestamp()) + hour * 3600) * 1_000_000 and k[1] == model}
    for signal, (window, total, p) in at.items():
        assert (window, total) == (guard.window_hours, guard.total_predictions)
        assert p is None or abs(p - plain[signal]) < 1e-9


def test_the_fallback_is_longer(spark):
    with pytest.raises(ValueError):
        rolling_counts_stream(spark.createDataFrame([], LOG), None, SIGNALS, hours=5, fallback=4)
