"""Views of the given tables that play the roles of log, scores, reviews and uploads.

Each view exists as a DataFrame here and as SQL text in ``registry.sql``.
Expressions on a text are taken before a join, so that a query which needs
only the length of a text does not shuffle the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import content_key
from plumbline.functions.labels import label_id
from plumbline.functions.scores import argmax, round_to, softmax
from plumbline.functions.text import text_length
from plumbline.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; times become UTC instants."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def rows_of(df: DataFrame):
    """Row count as a scalar subquery, answered from file footers."""
    return df.agg(F.count(F.lit(1))).scalar()


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without its texts: everything that comes from ``events`` alone."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    sentiment = (
        F.when(kind == "error", "negative").when(kind.isin("view", "click"), "neutral").otherwise("positive")
    )
    value = F.col("value")
    return (
        events.withColumn("sentiment", sentiment)
        .select(
            F.col("event_id").alias("row_id"),
            "ts",
            "sentiment",
            label_id("sentiment").cast("int").alias("label"),
            round_to(F.lit(0.34) + F.lit(0.66) * value / (value + F.lit(50.0)), 4).alias("confidence"),
            F.when(F.col("user_id") % 2 == 0, "social").otherwise("reviews").alias("model_used"),
        )
    )


def _events_about(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Every event with expressions on the text it is about; all documents take part in turn."""
    documents = table(spark, sf_dir, "documents")
    texts = documents.select(F.col("doc_id").alias("text_id"), *columns)
    events = event_rows(spark, sf_dir).withColumn("text_id", F.col("row_id") % rows_of(documents))
    return events.join(texts, "text_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_predictions``: every event with the text it is about."""
    return _events_about(spark, sf_dir, "text", text_length("text").alias("text_length")).select(
        "row_id", "ts", "text", "text_length", "sentiment", "label", "confidence", "model_used"
    )


def prediction_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and content key of every row of ``v_predictions``; no text meets an event."""
    return _events_about(spark, sf_dir, content_key("text").alias("content_key")).select("row_id", "ts", "content_key")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passthrough columns of an upload."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_reviews``: documents with star scores, polarity codes and some missing texts."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(doc % 17 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        (1 + doc % 5).cast("int").alias("stars"),
        (2 * (doc % 3)).cast("int").alias("polarity"),
    )


def logit(model: str, label: int):
    """A reproducible logit in [0, 4) of a text, from a portable hash."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{model}{label}-"), F.col("text"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0) * F.lit(4.0)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id`` and three logits of each of two models per document."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return documents.select(
        "row_id", *[logit(m, c).alias(f"{m}{c}") for m in ("s", "r") for c in range(3)]
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_scores``: class and confidence of both models per document, in one pass."""
    df = logits(spark, sf_dir)
    out = [F.col("row_id")]
    for m, name in (("s", "social"), ("r", "reviews")):
        items = [F.col(f"{m}{c}") for c in range(3)]
        out.append(argmax(items).alias(f"{name}_pred"))
        out.append(F.greatest(*softmax(items)).alias(f"{name}_conf"))
    return df.select(*out)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log over several years."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(status == "F", "negative").when(status == "O", "neutral").otherwise("positive").alias("sentiment"),
        F.pmod(F.col("o_custkey"), F.lit(3)).cast("string").alias("tenant"),
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request durations in seconds."""
    return table(spark, sf_dir, "events").select("ts", (F.col("value") / F.lit(10.0)).alias("seconds"))
