"""Search, listing and activity queries as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.functions.clock import instant, iso_format, iso_parse, shift
from chronoscribe.operators import scan, search as fts, stats
from chronoscribe.operators.stats import _beside


class InvalidRequest(ValueError):
    """The request breaks a documented rule."""


def _none():
    return F.lit(None).cast("string")


def _joined(col: str):
    return F.array_join(F.coalesce(F.col(col), F.array().cast("array<string>")), ", ")


def health(captures: DataFrame, summaries: DataFrame) -> DataFrame:
    return _beside(stats.capture_count(captures), stats.summary_count(summaries)).select(
        F.lit("ok").alias("status"), "capture_count", "summary_count")


def search(summaries: DataFrame, text: str, now, minutes: int = 1440, limit: int = 20, app: str | None = None,
           stem: bool = True, index: fts.TextIndex | None = None) -> DataFrame:
    """Citations of the best matching summaries, found through ``index`` if there is one."""
    text = text.strip()
    if not text:
        raise InvalidRequest("a search needs some text")
    if limit < 0:
        raise InvalidRequest("limit must not be negative")
    hits = fts.search_summaries(summaries, text, limit, now, minutes, app, stem, index)
    return hits.select(
        iso_format("startTs").alias("timestamp"), _joined("appNames").alias("app_name"),
        _none().alias("window_title"), F.col("summary").alias("relevant_text"),
        # Fixed value: the explanation's text is part of the output.
        F.concat(F.lit("FTS match — topics: "), _joined("keyTopics")).alias("relevance_explanation"),
        F.lit("summary").alias("source"))


def search_metadata(citations: DataFrame, text: str, minutes: int = 1440) -> DataFrame:
    return citations.agg(F.count(F.lit(1)).alias("summaries_searched")).select(
        F.lit(text.strip()).alias("query"), F.lit(minutes).alias("time_range_minutes"),
        F.lit(0).alias("captures_examined"), "summaries_searched")


def list_summaries(summaries: DataFrame, now, minutes: int = 60, limit: int = 50) -> DataFrame:
    minutes, limit = max(1, minutes), max(1, limit)
    end = instant(now)
    return scan.summaries_overlapping(summaries, shift(end, -60.0 * minutes), end, limit).select(
        iso_format("startTs").alias("start_timestamp"), iso_format("endTs").alias("end_timestamp"),
        F.col("appNames").alias("app_names"), "summary", F.col("keyTopics").alias("key_topics"))


def activity(captures: DataFrame, summaries: DataFrame, now, timestamp: str | None = None, window_minutes: int = 5,
             kind: str = "captures", limit: int = 100) -> DataFrame:
    """Captures or summaries around an instant. The window is the total width; a missing or
    unreadable timestamp means now."""
    if kind not in ("captures", "summaries"):
        raise InvalidRequest('"kind" must be "captures" or "summaries"')
    window_minutes, limit = max(1, window_minutes), max(1, limit)
    center = F.coalesce(iso_parse(F.lit(timestamp)), instant(now)) if timestamp is not None else instant(now)
    half = window_minutes * 60 / 2.0
    start, end = shift(center, -half), shift(center, half)
    if kind == "summaries":
        return scan.summaries_overlapping(summaries, start, end, limit).select(
            iso_format("startTs").alias("timestamp"), _joined("appNames").alias("app_name"),
            _none().alias("window_title"), F.col("summary").alias("text"), F.lit("summary").alias("kind"),
            _none().alias("frame_type"), F.lit(None).cast("double").alias("change_percentage"))
    return scan.captures_between(captures, start, end, limit).select(
        iso_format("ts").alias("timestamp"), F.col("appName").alias("app_name"),
        F.col("windowTitle").alias("window_title"), F.col("fullOcrText").alias("text"),
        F.lit("capture").alias("kind"), F.col("frameType").alias("frame_type"),
        F.col("changePercentage").alias("change_percentage"))
