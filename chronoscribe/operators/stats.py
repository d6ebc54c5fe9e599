"""Counts, histograms and top-k reports. Each is one pass with map-side combined aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.functions.clock import local_time, seconds_before
from chronoscribe.operators.scan import newest
from chronoscribe.operators.sequence import is_keyframe


def _is_delta():
    return F.col("frameType") == "delta"


def capture_count(captures: DataFrame) -> DataFrame:
    return captures.agg(F.count(F.lit(1)).alias("capture_count"))


def summary_count(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.count(F.lit(1)).alias("summary_count"))


def token_usage_totals(usage: DataFrame, now, caller: str | None = None, within: float = 86_400.0) -> DataFrame:
    """Token sums of one caller since ``now - within``; without a caller, one row per caller."""
    recent = usage.filter(F.col("ts") >= seconds_before(now, within))
    sums = [F.coalesce(F.sum("inputTokens"), F.lit(0)).alias("inputTokens"),
            F.coalesce(F.sum("outputTokens"), F.lit(0)).alias("outputTokens")]
    totals = (recent.groupBy("caller").agg(*sums) if caller is None
              else recent.filter(F.col("caller") == caller).agg(*sums))
    return (totals.withColumn("inputMtok", F.col("inputTokens") / F.lit(1e6))
            .withColumn("outputMtok", F.col("outputTokens") / F.lit(1e6)))


def table_stats(captures: DataFrame, summaries: DataFrame) -> DataFrame:
    """All row counts in one pass per table. Both sides are single rows."""
    c = captures.agg(
        F.count(F.lit(1)).alias("captures"), F.count_if(is_keyframe()).alias("keyframes"),
        F.count_if(_is_delta()).alias("deltas"), F.count_if(F.col("isSummarized")).alias("summarized"),
        F.count_if(~F.col("isSummarized")).alias("unsummarized"))
    s = summaries.agg(F.count(F.lit(1)).alias("summaries"))
    return _beside(c, s)


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of the one-row frame ``b`` beside those of ``a``, as one scalar subquery."""
    return a.withColumn("__b", b.select(F.struct("*")).scalar()).select("*", "__b.*").drop("__b")


def time_span(captures: DataFrame, tz: str = "UTC") -> DataFrame:
    span = captures.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select(F.coalesce(local_time("a", tz), F.lit("none")).alias("oldest"),
                       F.coalesce(local_time("b", tz), F.lit("none")).alias("newest"))


def top_apps(captures: DataFrame, k: int = 10) -> DataFrame:
    """Apps by number of captures, with their share of all captures; ties by name."""
    counts = captures.groupBy("appName").agg(F.count(F.lit(1)).alias("captures"))
    total = counts.agg(F.sum("captures").alias("__all"))
    top = counts.orderBy(F.col("captures").desc(), "appName").limit(k)
    return _beside(top, total).select("appName", "captures", (F.col("captures") / F.col("__all")).alias("share"))


def captures_per_hour(captures: DataFrame, now, hours: float = 24.0, tz: str = "UTC") -> DataFrame:
    """Captures after ``now - hours`` (strictly) per hour of zone ``tz``, ascending."""
    hour = F.date_format(F.from_utc_timestamp("ts", tz), "yyyy-MM-dd HH:00")
    return (captures.filter(F.col("ts") > seconds_before(now, hours * 3600))
            .groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("captures")).orderBy("hour"))


def frame_type_stats(captures: DataFrame) -> DataFrame:
    """Counts per frame type, mean delta change and text sizes, and the text saved by deltas.

    Means are cut to whole numbers before they are combined; without deltas only counts are given.
    """
    a = captures.agg(
        F.count_if(is_keyframe()).alias("keyframes"), F.count_if(_is_delta()).alias("deltas"),
        F.avg(F.when(_is_delta(), F.col("changePercentage"))).alias("__change"),
        F.sum(F.when(is_keyframe(), F.length("ocrText").cast("long"))).alias("__kf"),
        F.sum(F.when(_is_delta(), F.length("ocrText").cast("long"))).alias("__d"))
    kf = F.when(F.col("keyframes") == 0, F.lit(0)).otherwise(F.expr("__kf div keyframes"))
    b = a.withColumn("__akf", kf).withColumn("__ad", F.expr("try_divide(__d, deltas)").cast("long"))
    some = F.col("deltas") > 0
    saved = (F.lit(100.0) - F.col("__ad").cast("double") / F.col("__akf") * F.lit(100.0)).cast("long")
    return b.select(
        "keyframes", "deltas",
        F.when(some, (F.col("__change") * 100).cast("long")).alias("avg_delta_change_pct"),
        F.when(some, F.col("__akf").cast("long")).alias("avg_keyframe_chars"),
        F.when(some, F.col("__ad")).alias("avg_delta_chars"),
        F.when(some & (F.col("__akf") > 0), saved).alias("compression_pct"))


def summarization_progress(captures: DataFrame) -> DataFrame:
    a = captures.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("isSummarized")).alias("summarized"))
    return a.select("summarized", (F.col("total") - F.col("summarized")).alias("pending"),
                    F.when(F.col("total") > 0, F.col("summarized") / F.col("total")).alias("progress"))


def text_size_stats(captures: DataFrame) -> DataFrame:
    """Row count and mean text sizes (cut to whole numbers) per frame type."""
    return captures.groupBy("frameType").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.length("ocrText")).cast("long").alias("avg_ocr_chars"),
        F.avg(F.length("fullOcrText")).cast("long").alias("avg_full_chars"))


def keyframe_delta_counts(captures: DataFrame, k: int | None = 20, chars: int = 80, tz: str = "UTC") -> DataFrame:
    """Keyframes, newest first, with the number of their deltas.

    Deltas are counted per parent before the join. With ``k`` the keyframes are cut to the newest
    ``k`` first, so at most ``k`` rows are broadcast to the counts.
    """
    counts = (captures.filter(_is_delta() & F.col("keyframeId").isNotNull())
              .groupBy(F.col("keyframeId").alias("__kf")).agg(F.count(F.lit(1)).alias("__n")))
    heads = captures.filter(is_keyframe()).select(
        "id", "ts", F.col("appName").alias("app"), F.substring("fullOcrText", 1, chars).alias("text_preview"))
    if k is not None:
        heads = newest(heads, k)
    out = heads.join(counts, F.col("id") == F.col("__kf"), "left")
    return newest(out, k).select(
        "id", local_time("ts", tz).alias("time"), "app", F.coalesce("__n", F.lit(0)).alias("deltas"), "text_preview")
