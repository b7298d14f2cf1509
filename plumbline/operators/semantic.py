"""Semantic drift: embedding, PCA and k-means baseline, cluster shares, PSI."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.labels import MODELS
from plumbline.functions.text import SPACE_PATTERN
from plumbline.operators.drift import (
    FALLBACK_HOURS,
    INSUFFICIENT,
    MIN_ROWS,
    WINDOW_HOURS,
    Signal,
    latest,
    production_psi,
    recent,
    summarise,
    volume_guardrail,
)
from plumbline.operators.split import fresh_names, stratified_sample
from plumbline.plans.small import fitted, written

# Baseline size.
COMPONENTS, CLUSTERS, SEED = 5, 10, 42

SEMANTIC = Signal("semantic", "category", "cluster")


# ---------------------------------------------------------------- encoders


def fit_encoder(df: DataFrame, text_col: str = "text", features: int = 256) -> PipelineModel:
    """Default text encoder: hashed, inverse-frequency weighted, unit length."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=SPACE_PATTERN),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(df)


def encode(df: DataFrame, encoder: PipelineModel, out: str = "embedding") -> DataFrame:
    """Add the embedding of the default encoder as an array."""
    return encoder.transform(df).select(*df.columns, vector_to_array("_unit").alias(out))


def encode_with(
    df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text", out: str = "embedding"
) -> DataFrame:
    """Add the embedding of a user's encoder, loaded once per task and fed with Arrow batches.

    Only the text column travels to Python.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.tolist()), dtype=float)), index=texts.index)

    return df.withColumn(out, run(F.col(text_col)))


# ---------------------------------------------------------------- clusters


@dataclass
class SemanticBaseline:
    """Fitted projection and clusters with the expected share of every cluster."""

    model: PipelineModel
    expected: DataFrame


def cluster_share(df: DataFrame, k: int, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """``by..., cluster, n, share`` over the clusters 0 to k-1; empty clusters are kept."""
    counts = df.groupBy(*by).agg(
        *[F.count_if(F.col(cluster) == i).alias(f"c{i}") for i in range(k)],
        F.count(cluster).alias("total"),
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(i).alias("cluster"), F.col(f"c{i}").alias("n")) for i in range(k)])
    ).alias("r")
    return counts.select(*by, "total", rows).select(
        *by,
        "r.cluster",
        "r.n",
        F.coalesce(F.try_divide(F.col("r.n"), F.col("total")), F.lit(0.0)).alias("share"),
    )


def fit_semantic(
    df: DataFrame,
    id_col: str,
    embedding: str = "embedding",
    strata: Sequence[str] = (),
    components: int = COMPONENTS,
    clusters: int = CLUSTERS,
    max_rows: int | None = None,
    seed: int = SEED,
) -> SemanticBaseline:
    """Fit PCA and k-means on all rows, or on a stratified sample of ``max_rows``.

    The expected shares are those of all rows in either case. Rows without a vector are left out.
    """
    # Fitting reads the vectors many times; written, they are narrow files instead of a scan of all columns.
    known = df.where(F.col(embedding).isNotNull())
    vectors = as_vectors(written(known.select(F.col(embedding).cast("array<double>").alias("_array")), "vectors"))
    if max_rows is None:
        sample = vectors
    else:
        picked = stratified_sample(known, id_col, max_rows, strata, seed)
        sample = as_vectors(written(picked.select(F.col(embedding).cast("array<double>").alias("_array")), "sample"))
    n, width = sample.select(F.count(F.lit(1)), F.max(F.size(vector_to_array("_vector")))).first()
    pca = PCA(k=min(components, width, n), inputCol="_vector", outputCol="_reduced")
    kmeans = KMeans(k=min(clusters, n), seed=seed, featuresCol="_reduced", predictionCol="cluster")
    model = Pipeline(stages=[pca, kmeans]).fit(sample)
    shares = cluster_share(model.transform(vectors), model.stages[-1].summary.k)
    return SemanticBaseline(model, fitted(shares).df)


def as_vectors(arrays: DataFrame) -> DataFrame:
    return arrays.select(array_to_vector("_array").alias("_vector"))


def assign_clusters(df: DataFrame, model: PipelineModel, embedding: str = "embedding") -> DataFrame:
    """Add the ``cluster`` of every row under a fitted baseline; a row without a vector has none."""
    present = F.col(embedding).isNotNull()
    vectors = df.where(present).withColumn("_vector", array_to_vector(F.col(embedding).cast("array<double>")))
    found = model.transform(vectors).select(*df.columns, "cluster")
    return found.unionByName(df.where(~present).withColumn("cluster", F.lit(None).cast("int")))


def mean_centroids(df: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """``cluster, centroid``: the mean vector of every label, one mergeable sum per label."""
    vector = array_to_vector(F.col(embedding).cast("array<double>"))
    return (
        df.groupBy(F.col(label).alias("cluster"))
        .agg(Summarizer.mean(vector).alias("m"))
        .select("cluster", vector_to_array("m").alias("centroid"))
    )


def nearest_centroid(
    df: DataFrame, centroids: DataFrame, embedding: str = "embedding", out: str = "cluster"
) -> DataFrame:
    """Add the cluster with the least squared distance; the lower cluster wins a tie.

    Centroids are written once and travel in blocks of at most ``CENTROID_NUMBERS``
    coordinates, each a broadcast of its own. A plan meets ``BLOCKS_AT_ONCE`` of them;
    beyond that the rows are written with their best so far. A row without a vector has
    no cluster.
    """
    spark = df.sparkSession
    table = written(centroids.select("cluster", "centroid"), "centroids")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("w")).first()
    blocks = max(1, -(-size["n"] * (size["w"] or 1) // CENTROID_NUMBERS))
    best, rows = fresh_names([*df.columns, out], "_best")[0], df
    none = F.lit(None).cast("struct<distance:double,cluster:int>")
    for block in range(blocks):
        mine = table.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == block).collect()
        if not mine:
            continue
        found = nearest_of(spark, sorted((r["cluster"], r["centroid"]) for r in mine))(F.col(embedding))
        if best in rows.columns:
            old = F.col(best)
            nearer = old.isNull() | (found["distance"] < old["distance"]) | (
                (found["distance"] == old["distance"]) & (found["cluster"] < old["cluster"])
            )
            found = F.when(found["cluster"].isNotNull() & nearer, found).otherwise(old)
        rows = rows.withColumn(best, found)
        if block % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and block < blocks - 1:
            rows = written(rows, "nearest")
    if best not in rows.columns:
        rows = rows.withColumn(best, none)
    return rows.withColumn(out, F.col(best)["cluster"]).drop(best)


#: Coordinates of centroids that a block holds (16 MB), blocks in one plan, distances held at once (32 MB).
CENTROID_NUMBERS, BLOCKS_AT_ONCE, DISTANCES = 1 << 21, 8, 1 << 22


def nearest_rows(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest point of every row, the first of equals, and its squared distance.

    One matrix product gives all distances but for rounding; points that this leaves within its
    error of the least are compared again by their differences, which decides.
    """
    squares, scale = (points**2).sum(axis=1), np.sqrt((points**2).sum(axis=1).max())
    at, least = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, DISTANCES // len(points))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        own = (part**2).sum(axis=1)
        rough = squares - 2 * (part @ points.T)
        error = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(own) + scale) ** 2
        row, point = np.nonzero(~(rough > (rough.min(axis=1) + error)[:, None]))
        most = max(1, DISTANCES // x.shape[1])
        pieces = [slice(i, i + most) for i in range(0, len(row), most)]
        exact = np.concatenate([((part[row[p]] - points[point[p]]) ** 2).sum(axis=1) for p in pieces])
        order = np.lexsort((point, exact, row))
        first = order[np.searchsorted(row[order], np.arange(len(part)))]
        at[a : a + step], least[a : a + step] = point[first], exact[first]
    return at, least


def nearest_of(spark: SparkSession, centroids: list):
    """A function of a vector column to the nearest of these centroids and its distance."""
    names = np.array([c for c, _ in centroids], dtype="int32")
    shared = spark.sparkContext.broadcast((names, np.array([p for _, p in centroids], dtype=float)))

    @F.pandas_udf("distance double, cluster int")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        names, points = shared.value
        present = vectors.notna().to_numpy()
        out = pd.DataFrame({"distance": np.nan, "cluster": pd.array([None] * len(vectors), dtype="Int32")})
        if present.any():
            at, least = nearest_rows(np.stack(vectors[present].to_numpy()).astype(float), points)
            out.loc[present, "distance"] = least
            out.loc[present, "cluster"] = names[at]
        return out

    return nearest


# ---------------------------------------------------------------- drift


def semantic_baselines(expected: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Cluster shares as rows of the baseline table, for every model that uses them."""
    names = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    none = F.lit(None).cast("double")
    rows = expected.select(
        names,
        F.lit(SEMANTIC.name).alias("signal"),
        F.lit(SEMANTIC.column).alias("feature"),
        F.lit("category").alias("kind"),
        F.col("cluster").alias("bin"),
        none.alias("lo"),
        none.alias("hi"),
        F.col("cluster").cast("string").alias("category"),
        F.col("share").alias("expected"),
    )
    return fitted(rows).df


def model_baselines(shares: DataFrame, model_col: str = "model_used") -> DataFrame:
    """Cluster shares per model as rows of the baseline table: every model against its own past."""
    none = F.lit(None).cast("double")
    return shares.select(
        F.col(model_col).alias("model"),
        F.lit(SEMANTIC.name).alias("signal"),
        F.lit(SEMANTIC.column).alias("feature"),
        F.lit("category").alias("kind"),
        F.col("cluster").alias("bin"),
        none.alias("lo"),
        none.alias("hi"),
        F.col("cluster").cast("string").alias("category"),
        F.col("share").alias("expected"),
    )


def semantic_psi(log: DataFrame, baselines: DataFrame, model_col: str = "model_used") -> DataFrame:
    """``model, psi, rows`` of a log that carries a ``cluster`` column."""
    return production_psi(log, baselines, [SEMANTIC], model_col).select("model", "psi", "rows")


def semantic_drift_job(
    log: DataFrame,
    baselines: DataFrame,
    models: Sequence[str] = MODELS,
    hours: int = WINDOW_HOURS,
    fallback: int = FALLBACK_HOURS,
    min_rows: int = MIN_ROWS,
    now: Column | None = None,
    ts: str = "ts",
) -> DataFrame:
    """The semantic drift report: guardrail, per-model and ensemble scores.

    Below the minimum volume the report is one row that says so.
    """
    end = latest(log, ts) if now is None else now
    guard = fitted(volume_guardrail(log, hours, fallback, min_rows, end, ts))
    verdict = guard.rows[0]
    about = {
        "window_hours": F.lit(verdict["window_hours"]),
        "lookback_expanded": F.lit(verdict["lookback_expanded"]),
        "total_predictions": F.lit(verdict["total_predictions"]).cast("long"),
    }
    if verdict["status"] == INSUFFICIENT:
        report = guard.df.select(
            F.lit("ensemble").alias("model"),
            F.lit(SEMANTIC.name).alias("signal"),
            F.lit(None).cast("double").alias("psi"),
            F.lit("unknown").alias("level"),
            F.lit(0.0).alias("risk_pct"),
            "status",
            F.col("total_predictions").cast("long").alias("n"),
        )
    else:
        window = recent(log, verdict["window_hours"], end, ts)
        scores = production_psi(window, baselines, [SEMANTIC])
        volume = window.groupBy(F.col("model_used").alias("model")).agg(F.count(F.lit(1)).alias("n"))
        report = summarise(scores, volume, [SEMANTIC.name], models)
    return report.withColumns(about)
