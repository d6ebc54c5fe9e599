"""Canonical tables over general activity, text, order and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscribe import schema as S

BASE = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _at(seconds) -> Column:
    base = F.unix_micros(F.to_timestamp(F.lit(BASE)))
    return F.timestamp_micros(base + seconds.cast("long") * 1_000_000)


def captures_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as captures of devices: the type is the app, a large value is a keyframe."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("device"),
        F.col("event_type").alias("appName"), F.lit(None).cast("string").alias("appBundleID"),
        F.lit(None).cast("string").alias("windowTitle"), F.col("props").alias("ocrText"),
        F.col("props").alias("fullOcrText"), F.col("props").alias("visibleWindows"),
        F.sha2("props", 256).alias("textHash"), (F.col("event_id") % 3 == 0).alias("isSummarized"),
        F.when(F.col("value") >= 250, F.lit("keyframe")).otherwise(F.lit("delta")).alias("frameType"),
        F.when(F.col("value") < 250, F.col("event_id") - F.col("event_id") % 10).alias("keyframeId"),
        (F.col("value") / 500).alias("changePercentage"))


def captures_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as keyframes: one a minute, the source is the app, the language the title."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("id"), _at(F.col("doc_id") * 60).alias("ts"), F.col("source").alias("appName"),
        F.lit(None).cast("string").alias("appBundleID"), F.col("lang").alias("windowTitle"),
        F.col("text").alias("ocrText"), F.col("text").alias("fullOcrText"),
        F.lit(None).cast(S.WINDOWS).alias("visibleWindows"),
        (F.col("doc_id") % 3 == 0).alias("isSummarized"), F.lit("keyframe").alias("frameType"),
        F.lit(None).cast("long").alias("keyframeId"), F.lit(1.0).alias("changePercentage"))


def captures_of_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as devices: what the user says is a keyframe, other turns are deltas."""
    c = table(spark, folder, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), _at(F.col("conv_id") * 3600 + F.col("turn") * 2).alias("ts"),
        F.col("conv_id").alias("device"), F.col("role").alias("appName"),
        F.lit(None).cast("string").alias("appBundleID"), F.lit(None).cast("string").alias("windowTitle"),
        F.col("text").alias("ocrText"), F.col("text").alias("fullOcrText"),
        F.lit(None).cast(S.WINDOWS).alias("visibleWindows"), F.lit(False).alias("isSummarized"),
        F.when(F.col("role") == "user", F.lit("keyframe")).otherwise(F.lit("delta")).alias("frameType"),
        F.when(F.col("role") != "user", F.col("conv_id") * 1000).alias("keyframeId"),
        (F.length("text") % 100 / 100).alias("changePercentage"))


def observations_of_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as observations 20 s apart; the changed share comes from the text length."""
    c = table(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("device"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        _at(F.col("conv_id") * 3600 + F.col("turn") * 20).alias("ts"), F.col("role").alias("appName"),
        F.lit(None).cast("string").alias("windowTitle"), (F.length("text") % 8 / 10).alias("changedFraction"),
        F.col("text").alias("fullText"), F.col("text").alias("changedText"))


def summaries_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as summaries: five minutes each, one a minute; each covers its own capture."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("id"), _at(F.col("doc_id") * 60).alias("startTs"),
        _at(F.col("doc_id") * 60 + 300).alias("endTs"), F.array("source").alias("appNames"),
        F.col("text").alias("summary"), F.array("lang", "source").alias("keyTopics"),
        F.array(F.col("doc_id")).alias("captureIds"))


def usage_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderpriority").alias("caller"), F.col("o_orderstatus").alias("model"),
        F.col("o_totalprice").cast("long").alias("inputTokens"), F.col("o_custkey").alias("outputTokens"))


def tiles_of_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as one tile of numbers per frame; the label is the stream."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("label").alias("stream"), F.col("vec_id").alias("ts"), F.col("vec_id").alias("id"),
                    F.col("embedding").alias("values"))
