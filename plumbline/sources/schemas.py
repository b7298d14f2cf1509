"""Explicit schemas of every source and sink."""

from __future__ import annotations

from pyspark.sql import types as T

SOCIAL = T.StructType(
    [
        T.StructField("target", T.IntegerType()),
        T.StructField("ids", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("flag", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

LABELLED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

PREDICTION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_length", T.IntegerType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("model_used", T.StringType()),
    ]
)

BASELINE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("bin", T.IntegerType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("expected", T.DoubleType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
