from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators.drift import PREDICTION, TARGET, build_baselines, production_psi
from plumbline.operators.lifecycle import anchored_windows, daily_counts
from plumbline.operators.scoring import BatchScorer, predict
from plumbline.sources.log import read_log
from plumbline.streaming.queries import (
    counters_stream,
    drift_stream,
    lifecycle_stream,
    read_files,
    run_available,
    score_stream,
)

LOG = "ts timestamp, sentiment string, tenant string, model_used string, label int, confidence double"
START = datetime(2024, 1, 1)


def rows(n, days, seed):
    rng = np.random.default_rng(seed)
    names = ["negative", "neutral", "positive"]
    out = []
    for i in range(n):
        label = int(rng.integers(0, 3))
        out.append(
            (
                START + timedelta(minutes=int(rng.integers(days[0] * 1440, days[1] * 1440))),
                names[label], "hot" if i % 3 else f"t{i % 5}", ["social", "reviews"][i % 2], label,
                float(rng.uniform(0.4, 1)),
            )
        )
    return out


def put(spark, data, path, mode="append"):
    spark.createDataFrame(data, LOG).coalesce(1).write.mode(mode).parquet(str(path))


def test_scoring_stream_equals_batch_and_logs_once(spark, tmp_path):
    def load():
        return lambda texts: np.array([[0.6, 0.3, 0.1] if "bad" in t else [0.1, 0.2, 0.7] for t in texts])

    scorers = {"social": BatchScorer(load), "reviews": BatchScorer(load)}
    schema = "review string, customer_id string"
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    first = spark.createDataFrame([("bad thing", "a"), ("nice", "b"), (None, "c")], schema)
    first.write.mode("append").json(source)
    run = lambda: run_available(score_stream(read_files(spark, source, schema, "json"), scorers, out), checkpoint)
    run()
    run()
    spark.createDataFrame([("bad again", "d")], schema).write.mode("append").json(source)
    run()
    got = read_log(spark, out).select("text", "sentiment", "label", "confidence", "model_used", "text_length")
    texts = spark.createDataFrame([("bad thing",), ("nice",), ("bad again",)], "text string")
    want = predict(texts, scorers).withColumn("text_length", F.length("text")).select(*got.columns)
    assert got.count() == 3
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_counters_equal_batch_on_closed_days_and_drop_late_rows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    early, late = rows(300, (0, 5), 1), rows(200, (5, 8), 2)
    for data in (early, late):
        put(spark, data, source)
        stream = counters_stream(read_files(spark, str(source), LOG))
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
        run_available(writer, str(tmp_path / "cp"))
    end = max(r[0] for r in early + late) - timedelta(hours=1)
    closed = daily_counts(spark.createDataFrame(early + late, LOG)).where(F.col("day") + F.expr("interval 1 day") <= F.lit(end))
    got = spark.read.parquet(out).select("day", "sentiment", "n")
    assert got.exceptAll(closed).isEmpty() and closed.exceptAll(got).isEmpty()
    put(spark, rows(50, (0, 1), 3), source)
    before = got.count()
    stream = counters_stream(read_files(spark, str(source), LOG))
    run_available(stream.writeStream.format("parquet").option("path", out).outputMode("append"), str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == before


def test_drift_stream_equals_batch(spark, tmp_path):
    signals = [TARGET, PREDICTION]
    train = spark.createDataFrame(rows(500, (0, 3), 4), LOG)
    base = build_baselines(train, signals)
    source, out = tmp_path / "in", str(tmp_path / "out")
    data = []
    for seed, days in ((5, (3, 5)), (6, (5, 7))):
        part = rows(400, days, seed)
        data += part
        put(spark, part, source)
        run_available(drift_stream(read_files(spark, str(source), LOG), base, out, signals), str(tmp_path / "cp"))
    got = {
        (r.window_start, r.model, r.signal): (r.psi, r.rows)
        for r in spark.read.option("recursiveFileLookup", True).parquet(out).collect()
    }
    assert {k[0] for k in got} == {START + timedelta(days=d) for d in (3, 4, 5)}
    for day in (3, 4, 5):
        begin = START + timedelta(days=day)
        part = [r for r in data if begin <= r[0] < begin + timedelta(days=1)]
        for r in production_psi(spark.createDataFrame(part, LOG), base, signals).collect():
            psi, n = got[begin, r.model, r.signal]
            assert abs(psi - r.psi) < 1e-12 and n == r.rows


def test_lifecycle_stream_keeps_its_windows_across_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    data = []
    for seed, days in ((7, (0, 200)), (8, (201, 400)), (9, (401, 700))):
        part = rows(300, days, seed)
        data += part
        put(spark, part, source)
        stream = lifecycle_stream(read_files(spark, str(source), LOG))
        run_available(
            stream.writeStream.format("parquet").option("path", out).outputMode("append"), str(tmp_path / "cp")
        )
    last_day = max(r[0] for r in data).replace(hour=0, minute=0)
    batch = (
        anchored_windows(spark.createDataFrame(data, LOG), by=["tenant"])
        .where(F.col("end_date").isNotNull() & (F.col("end_date") < F.lit(last_day)))
    )
    columns = ["tenant", "start_date", "end_date", "negative", "neutral", "positive", "total"]
    got, want = spark.read.parquet(out).where(F.col("end_date") < F.lit(last_day)).select(*columns), batch.select(*columns)
    assert want.count() > 10
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
