import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators.split import split_counts, stratified_sample, stratified_split


def frame(spark, sizes):
    rows, i = [], 0
    for stratum, n in sizes.items():
        for _ in range(n):
            rows.append((i, stratum))
            i += 1
    return spark.createDataFrame(rows, "id long, s string").repartition(5), rows


def brute_order(rows, seed=42):
    groups = defaultdict(list)
    for i, s in rows:
        groups[s].append((hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), i))
    return {s: [i for _, i in sorted(g)] for s, g in groups.items()}


@pytest.mark.parametrize("sizes", [{"a": 700, "b": 200, "c": 100}, {"a": 3, "b": 1, None: 996}])
def test_sample_equals_brute_force(spark, sizes):
    df, rows = frame(spark, sizes)
    got = stratified_sample(df, "id", 100, ["s"]).collect()
    assert len(got) == 100
    order = brute_order(rows)
    taken = Counter(r.s for r in got)
    for s, n in sizes.items():
        assert abs(taken[s] - 100 * n / 1000) < 1
        assert {r.id for r in got if r.s == s} == set(order[s][: taken[s]])


def test_sample_of_small_input_is_the_input(spark):
    df, rows = frame(spark, {"a": 30, "b": 12})
    assert sorted(stratified_sample(df, "id", 100, ["s"]).collect()) == sorted(rows)
    assert stratified_sample(df, "id", 100).count() == 42


def test_plain_sample(spark):
    df, rows = frame(spark, {"a": 500})
    got = {r.id for r in stratified_sample(df, "id", 77).collect()}
    assert got == set(brute_order(rows)["a"][:77])


def test_split_is_disjoint_complete_and_proportional(spark):
    sizes = {"a": 5000, "b": 900, "c": 100}
    df, rows = frame(spark, sizes)
    out = stratified_split(df, "id", "s", holdout=0.1, test_share=0.5).cache()
    assert out.count() == 6000 and out.select("id").distinct().count() == 6000
    counts = {r.split: r.n for r in split_counts(out).collect()}
    assert counts == {"train": 5400, "val": 300, "test": 300}
    parts = [out.where(F.col("split") == s).select("id") for s in ("train", "val", "test")]
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            assert a.intersect(b).isEmpty()
    held = out.where(F.col("split") != "train").groupBy("s").count().collect()
    for r in held:
        assert abs(r["count"] - sizes[r.s] * 0.1) <= 1
    order = brute_order(rows)
    test = {r.id for r in out.where((F.col("split") == "test") & (F.col("s") == "a")).collect()}
    assert test == set(order["a"][: len(test)])


def test_split_rounds_up_like_a_holdout(spark):
    df, _ = frame(spark, {"a": 101})
    counts = {r.split: r.n for r in split_counts(stratified_split(df, "id", None, 0.01, 0.99)).collect()}
    assert counts == {"train": 99, "test": 2}


def test_seed_changes_the_split(spark):
    df, _ = frame(spark, {"a": 200})
    one = {r.id for r in stratified_split(df, "id", "s", 0.2, 0.5, seed=1).where("split = 'test'").collect()}
    two = {r.id for r in stratified_split(df, "id", "s", 0.2, 0.5, seed=2).where("split = 'test'").collect()}
    assert one != two


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, s string")
    assert stratified_split(df, "id", "s").isEmpty()
    assert stratified_sample(df, "id", 10).isEmpty()
