import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import binning
from plumbline.operators.binning import (
    DEFAULT_CONFIDENCE_EDGES,
    categorical_frequency,
    counted_quantile_edges,
    equal_width_edges,
    histogram,
    merged_counts,
    quantile_edges,
    value_counts,
)

NAN = float("nan")


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def edges_frame(spark, edges):
    return spark.createDataFrame([([float(e) for e in edges],)], "edges array<double>")


def numpy_edges(values, n=10):
    out = np.unique(np.percentile(np.asarray(values, float), np.linspace(0, 100, n + 1)))
    return out if len(out) > 1 else np.array([out[0] - 0.5, out[0] + 0.5])


@pytest.mark.parametrize(
    "values, expected",
    [([], [0.0, 1.0]), ([5, 5, 5], [4.5, 5.5]), ([7], [6.5, 7.5]), ([None, NAN], [0.0, 1.0])],
)
def test_degenerate_quantiles(spark, values, expected):
    assert quantile_edges(column(spark, values), "x").first().edges == expected


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = [
        rng.normal(size=997),
        rng.integers(0, 12, 500),
        np.concatenate([np.zeros(400), rng.exponential(size=50)]),
        rng.lognormal(sigma=3, size=2000),
    ][seed]
    got = quantile_edges(column(spark, values), "x").first().edges
    np.testing.assert_allclose(got, numpy_edges(values), rtol=1e-12, atol=1e-12)


def test_quantiles_are_exact_with_a_coarse_sketch(spark):
    """The sketch may be as poor as it likes: counts decide."""
    values = np.random.default_rng(5).permutation(3000) ** 1.5
    got = quantile_edges(column(spark, values), "x", accuracy=3, slack=0.02).first().edges
    np.testing.assert_allclose(got, numpy_edges(values), rtol=1e-12)


def test_grouped_quantiles_with_a_hot_and_an_empty_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", 1.0)] * 600 + [("hot", float(v)) for v in rng.normal(size=300)]
    rows += [("small", float(v)) for v in rng.normal(size=20)] + [("none", None)]
    got = {r.g: r.edges for r in quantile_edges(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    for g in ("hot", "small"):
        np.testing.assert_allclose(got[g], numpy_edges([v for k, v in rows if k == g]), rtol=1e-12)
    assert got["none"] == [0.0, 1.0]


@pytest.mark.parametrize(
    "edges, values, freq",
    [
        ([0, 1, 2], [2], [0.0, 1.0]),
        ([0, 1, 2], [-1, 0.5, 3], [1.0, 0.0]),
        ([0, 1, 2], [1, None, NAN, 2], [0.0, 1.0]),
        ([0, 1, 2], [], [0.5e-4, 0.5e-4]),
    ],
)
def test_histogram_cases(spark, edges, values, freq):
    out = histogram(column(spark, values), "x", edges_frame(spark, edges)).orderBy("bin").collect()
    assert [r.freq for r in out] == freq


@pytest.mark.parametrize("n_edges", [2, 11, 40])
def test_histogram_equals_numpy(spark, n_edges):
    rng = np.random.default_rng(n_edges)
    values, edges = rng.integers(-10, 110, 3000), np.linspace(0, 100, n_edges)
    out = histogram(column(spark, values), "x", edges_frame(spark, edges)).orderBy("bin").collect()
    assert [r.n for r in out] == np.histogram(values, edges)[0].tolist()


def test_open_ends_count_the_tails(spark):
    out = histogram(column(spark, [-5, 0.5, 9]), "x", edges_frame(spark, [0, 1, 2]), open_ends=True)
    assert [r.n for r in out.orderBy("bin").collect()] == [2, 1]


def test_equal_width(spark):
    row = equal_width_edges(column(spark, [0.2, 0.9, NAN, None]), "x").first()
    np.testing.assert_allclose(row.edges, np.linspace(0.2, 0.9, 11), rtol=1e-12)
    assert row.measured
    row = equal_width_edges(column(spark, []), "x").first()
    assert tuple(row.edges) == DEFAULT_CONFIDENCE_EDGES and not row.measured
    assert equal_width_edges(column(spark, [0.5, 0.5]), "x").first().edges == [0.0, 1.0]


def test_categories_outside_the_list_count_in_the_total(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("z",), ("b",), (None,)], "c string")
    listed = spark.createDataFrame([("a",), ("b",), ("q",)], "c string")
    got = {r.c: r.freq for r in categorical_frequency(rows, "c", listed).collect()}
    assert got == {"a": 0.5, "b": 0.25, "q": 0.0}
    empty = categorical_frequency(rows.where(F.lit(False)), "c", listed).collect()
    assert all(abs(r.freq - 1e-4 / 3) < 1e-15 for r in empty)


def test_value_counts_stand_for_the_rows(spark):
    rng = np.random.default_rng(5)
    data = [(["a", "b", None][i % 3], None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(rng.integers(0, 60))) for i in range(4_000)]
    data += [("empty", None)] * 5
    rows = spark.createDataFrame(data, "g string, v double").repartition(6)
    counts = value_counts(rows, "v", ["g"])
    got = {r.g: r.edges for r in counted_quantile_edges(counts, ["g"]).collect()}
    want = {r.g: r.edges for r in quantile_edges(rows.where("g is not null"), "v", ["g"]).collect()}
    assert {g: e for g, e in got.items() if g is not None} == want and got["empty"] == [0.0, 1.0] and None in got
    first, second = rows.where("v < 30 or v is null"), rows.where("not (v < 30 or v is null)")
    merged = merged_counts(value_counts(first, "v", ["g"]), value_counts(second, "v", ["g"]), by=["g"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, counts.collect()))
    edges = quantile_edges(rows.where("g = 'a'"), "v")
    plain = histogram(rows.where("g = 'a'"), "v", edges).collect()
    assert histogram(counts.where("g = 'a'"), "x", edges, weight="n").collect() == plain


def test_category_counts_stand_for_the_rows(spark):
    rows = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2 + [(None,)] + [("odd",)], "c string")
    listed = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    counts = rows.groupBy("c").count().withColumnRenamed("count", "n")
    plain = sorted(map(tuple, categorical_frequency(rows, "c", listed).collect()))
    assert sorted(map(tuple, categorical_frequency(counts, "c", listed, weight="n").collect())) == plain


def test_no_task_sorts_a_wide_band(spark, monkeypatch):
    """A million distinct values: bands are narrowed until they are small, and the result stays exact."""
    n, seen = 1_000_000, []
    plain = binning.narrowed

    def spy(*args):
        sliced, targets = plain(*args)
        bands = binning.in_bands(sliced, targets, []).groupBy("slice").agg(F.count_distinct("x").alias("n"))
        seen.append(bands.agg(F.max("n")).first()[0])
        return sliced, targets

    monkeypatch.setattr(binning, "narrowed", spy)
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.sqrt(F.col("id").cast("double"))).alias("x"))
    got = quantile_edges(df, "x", band_rows=200).first().edges
    values = np.where(np.arange(n) % 3 == 0, 0.0, np.sqrt(np.arange(n, dtype=float)))
    np.testing.assert_allclose(got, numpy_edges(values), rtol=1e-12)
    assert len(seen) == 1 and seen[0] <= 200


def test_narrow_bands_with_groups_and_a_poor_sketch(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 900)] + [("b", float(v)) for v in rng.normal(size=700)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.edges for r in quantile_edges(df, "x", ["g"], accuracy=20, slack=0.2, band_rows=10).collect()}
    for g in ("a", "b"):
        np.testing.assert_allclose(got[g], numpy_edges([v for k, v in rows if k == g]), rtol=1e-12)
