import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.lifecycle import (
    COUNTS,
    accumulation,
    anchored_windows,
    archive,
    archived_total,
    chain,
    lifecycle_views,
    memory_view,
    period_delta,
    running_accumulation,
    sliding_counts,
)

START = datetime(2020, 1, 1)
KINDS = ["negative", "neutral", "positive"]


def log(spark, days, tenants=None):
    rows = [(START + timedelta(days=d), KINDS[i % 3], (tenants or ["t"])[i % len(tenants or ["t"])]) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "ts timestamp, sentiment string, tenant string"), rows


def fold(rows, days=91):
    windows = []
    for ts, kind, _ in sorted(rows, key=lambda r: r[0]):
        if not windows or ts - windows[-1]["start"] >= timedelta(days=days):
            if windows:
                windows[-1]["end"] = ts
            windows.append({"start": ts, "end": None, **dict.fromkeys(KINDS, 0)})
        windows[-1][kind] += 1
    return windows


def as_set(windows):
    return {(w["start"], w["end"], w["negative"], w["neutral"], w["positive"]) for w in windows}


def test_window_moves_with_the_data(spark):
    df, _ = log(spark, [0, 90, 91, 400])
    got = anchored_windows(df).orderBy("start_date").collect()
    assert [((r.start_date - START).days, r.end_date and (r.end_date - START).days, r.total) for r in got] == [
        (0, 91, 2), (91, 400, 1), (400, None, 1),
    ]


def test_equals_an_ordered_fold(spark):
    rng = random.Random(1)
    df, rows = log(spark, [rng.randrange(3000) for _ in range(400)], ["a", "b", "c"])
    got = anchored_windows(df, by=["tenant"]).collect()
    for tenant in "abc":
        want = fold([r for r in rows if r[2] == tenant])
        assert {(r.start_date, r.end_date, r.negative, r.neutral, r.positive) for r in got if r.tenant == tenant} == as_set(want)
    whole = anchored_windows(df).collect()
    assert {(r.start_date, r.end_date, r.negative, r.neutral, r.positive) for r in whole} == as_set(fold(rows))


def test_newest_hundred_archives_are_kept(spark):
    df, rows = log(spark, [i * 91 for i in range(104)])
    windows = anchored_windows(df)
    kept = archive(windows)
    assert windows.count() == 104 and kept.count() == 100
    assert kept.agg(F.min("start_date")).first()[0] == START + timedelta(days=3 * 91)
    assert accumulation(windows).first().created_at == START + timedelta(days=103 * 91)
    assert archived_total(kept).first().total == 100


def test_later_archive_of_a_date_replaces_the_earlier(spark):
    schema = "start_date timestamp, end_date timestamp, negative long, neutral long, positive long, total long"
    rows = [
        (START, START + timedelta(hours=1), 1, 0, 0, 1),
        (START + timedelta(hours=1), START + timedelta(hours=2), 0, 2, 0, 2),
    ]
    got = memory_view(spark.createDataFrame(rows, schema)).collect()
    assert [(r.period, r.neutral, r.total) for r in got] == [("2020-01-01", 2, 2)]


def test_views(spark):
    df, _ = log(spark, [0, 10, 91, 95, 95])
    got = {r.view: (r.period, r.total) for r in lifecycle_views(df).collect()}
    assert got == {"inference": ("2020-04-05", 2), "accumulation": ("2020-04-01", 3), "memory": ("2020-01-01", 2)}


def test_delta_and_running(spark):
    df, rows = log(spark, [0, 1, 2, 91, 92, 93, 94, 182])
    deltas = period_delta(archive(anchored_windows(df))).where("sentiment = 'negative'").orderBy("start_date").collect()
    assert [(r.n, r.previous, r.delta, r.delta_pct) for r in deltas] == [(1, None, None, None), (2, 1, 1, 100.0)]
    last = running_accumulation(df).groupBy("start_date").agg(F.max_by("running", "tick").alias("x"))
    assert last.count() == 3
    total = running_accumulation(df).groupBy("start_date", "sentiment").agg(F.max("running").alias("r"), F.sum("n").alias("n"))
    assert total.where("r <> n").isEmpty()


def test_sliding_equals_row_expansion(spark):
    rng = random.Random(4)
    rows = [(START + timedelta(minutes=rng.randrange(5000)), KINDS[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, sentiment string")
    got = sliding_counts(df, hours=24, slide_hours=6)
    direct = df.groupBy(F.window("ts", "24 hours", "6 hours")["start"].alias("window_start")).agg(
        *[F.count_if(F.col("sentiment") == k).alias(k) for k in KINDS], F.count("*").alias("total")
    )
    columns = ["window_start", *COUNTS]
    assert got.select(*columns).exceptAll(direct.select(*columns)).isEmpty()
    assert direct.select(*columns).exceptAll(got.select(*columns)).isEmpty()


@pytest.mark.parametrize("shape", ["dense", "bursts", "gaps"])
def test_exact_times_equal_an_ordered_fold(spark, shape):
    """Starts that differ by microseconds, in cells with many ticks, come out as one after another finds them."""
    rng = random.Random(5)
    step = {
        "dense": lambda: rng.randrange(60_000_000),
        "bursts": lambda: rng.choice([1, 2, 3, 86_400_000_000]) if rng.random() < 0.01 else rng.randrange(3),
        "gaps": lambda: rng.randrange(200_000_000) if rng.random() < 0.999 else rng.randrange(10 * 86_400_000_000),
    }[shape]
    at, rows = START, []
    for i in range(30_000):
        at += timedelta(microseconds=step())
        rows.append((at, KINDS[i % 3], "t"))
    df = spark.createDataFrame(rows, "ts timestamp, sentiment string, tenant string")
    want = as_set(fold(rows, 1))
    assert len(want) > 5
    for by in ([], ["tenant"]):
        got = anchored_windows(df, by=by, days=1).collect()
        assert {(r.start_date, r.end_date, r.negative, r.neutral, r.positive) for r in got} == want


def test_no_task_reads_the_ticks_in_order(spark):
    df, _ = log(spark, range(10), ["a", "b"])
    plan = anchored_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan.replace("Sort [_tenant", "") and "Coalesce" not in plan


def test_bounds_of_starts_hold_the_starts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        ticks = np.unique(rng.integers(0, 3000, rng.integers(1, 200)))
        span, width = int(rng.integers(1, 400)), int(rng.integers(1, 60))
        starts = [int(ticks[0])]
        while (after := ticks[ticks >= starts[-1] + span]).size:
            starts.append(int(after[0]))
        edges = np.unique(ticks // width, return_index=True)[1]
        first, last = ticks[edges], ticks[np.append(edges[1:], len(ticks)) - 1]
        low, high = chain(first, last, span)
        assert len(low) >= len(starts) and all(a <= s <= b for a, s, b in zip(low, starts, high))
        assert width > 1 or (low == starts and high == starts)
