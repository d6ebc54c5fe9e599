"""Summarised flag and retention. Tables are append-only: the flag is derived, pruning is a rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.functions.clock import seconds_before


def summarized_ids(summaries: DataFrame) -> DataFrame:
    """Distinct ids of the captures that some summary covers."""
    return summaries.select(F.explode("captureIds").alias("id")).distinct()


def mark_summarized(captures: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Set ``isSummarized`` for the given ids; an empty list changes nothing."""
    if not isinstance(ids, DataFrame):
        if not ids:
            return captures
        return captures.withColumn("isSummarized", F.col("isSummarized") | F.col("id").isin(list(ids)))
    hit = ids.select(F.col(ids.columns[0]).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    return (captures.join(hit, F.col("id") == F.col("__id"), "left")
            .withColumn("isSummarized", F.col("isSummarized") | F.coalesce("__hit", F.lit(False)))
            .drop("__id", "__hit"))


def derive_summarized(captures: DataFrame, summaries: DataFrame) -> DataFrame:
    """The flag as a function of the summaries table, so that no second write can be lost."""
    return mark_summarized(captures.withColumn("isSummarized", F.lit(False)), summarized_ids(summaries))


def unsummarized(captures: DataFrame, summaries: DataFrame) -> DataFrame:
    return captures.join(summarized_ids(summaries), "id", "left_anti")


def prune_captures(captures: DataFrame, now, days: float = 7.0) -> DataFrame:
    return captures.filter(F.col("ts") >= seconds_before(now, days * 86_400))


def prune_summaries(summaries: DataFrame, now, days: float = 7.0) -> DataFrame:
    """Age of a summary is the age of its end."""
    return summaries.filter(F.col("endTs") >= seconds_before(now, days * 86_400))


def prune_token_usage(usage: DataFrame, now, days: float = 7.0) -> DataFrame:
    return usage.filter(F.col("ts") >= seconds_before(now, days * 86_400))


def pruned_count(df: DataFrame, now, days: float = 7.0, ts: str = "ts") -> DataFrame:
    """Number of rows the matching prune removes."""
    return df.filter(F.col(ts) < seconds_before(now, days * 86_400)).agg(F.count(F.lit(1)).alias("deleted"))
