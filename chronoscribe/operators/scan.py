"""Filters and projections over captures and summaries.

Times are compared on the raw column so that the predicate reaches the Parquet
scan. ``now`` is always an argument. Equal times are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe import schema as S
from chronoscribe.functions.clock import instant, local_time, seconds_before
from chronoscribe.functions.numbers import percent_text, whole_percent
from chronoscribe.functions.text import preview
from chronoscribe.operators.sequence import is_keyframe


def newest(df: DataFrame, limit: int | None, ts: str = "ts", id: str = "id") -> DataFrame:
    """Newest first. With a limit this is a top-k over partitions, not a global sort."""
    out = df.orderBy(F.col(ts).desc(), F.col(id).desc())
    return out if limit is None else out.limit(limit)


def oldest(df: DataFrame, limit: int | None, ts: str = "ts", id: str = "id") -> DataFrame:
    out = df.orderBy(F.col(ts), F.col(id))
    return out if limit is None else out.limit(limit)


def captures_between(captures: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    return newest(captures.filter(F.col("ts").between(instant(start), instant(end))), limit)


def captures_by_ids(captures: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Rows with the given ids, newest first: a semi-join with the frame (or list) of ids."""
    if not isinstance(ids, DataFrame):
        ids = captures.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    wanted = ids.select(F.col(ids.columns[0]).alias("__id"))
    return newest(captures.join(wanted, F.col("id") == F.col("__id"), "left_semi"), None)


def unsummarized_older_than(captures: DataFrame, now, age: float = 300.0, limit: int | None = None) -> DataFrame:
    old = (~F.col("isSummarized")) & (F.col("ts") <= seconds_before(now, age))
    return oldest(captures.filter(old), limit)


def unsummarized_between(captures: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    hit = (~F.col("isSummarized")) & F.col("ts").between(instant(start), instant(end))
    return newest(captures.filter(hit), limit)


def _newest_of(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    order = F.struct(F.col("ts"), F.col("id"))
    return df.groupBy(*keys).agg(F.max_by(value, order).alias("v"))


def last_text_hash(captures: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Hash of the newest row (per key): one map-side combined aggregate."""
    keys = list(keys)
    return _newest_of(captures, keys, F.col("textHash")).select(*keys, F.col("v").alias("textHash"))


def last_keyframe(captures: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Newest keyframe (per key), all columns. The id is found first; the wide row is fetched last."""
    keys = list(keys)
    ids = _newest_of(captures.filter(is_keyframe()), keys, F.col("id")).select(F.col("v").alias("__id"))
    if not keys:
        # One row by construction: a global aggregate.
        ids = F.broadcast(ids)
    return captures.join(ids, F.col("id") == F.col("__id"), "left_semi")


def keyframes_between(captures: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    return captures_between(captures.filter(is_keyframe()), start, end, limit)


def deltas_of(captures: DataFrame, keyframe_id: int | DataFrame) -> DataFrame:
    """Children of one keyframe, or of every id in a frame, oldest first."""
    deltas = captures.filter(F.col("frameType") == "delta")
    if isinstance(keyframe_id, DataFrame):
        wanted = keyframe_id.select(F.col(keyframe_id.columns[0]).alias("__id"))
        hit = deltas.join(wanted, F.col("keyframeId") == F.col("__id"), "left_semi")
    else:
        hit = deltas.filter(F.col("keyframeId") == F.lit(keyframe_id))
    return oldest(hit, None)


def recent_captures(captures: DataFrame, n: int = 10, tz: str = "UTC") -> DataFrame:
    return newest(captures, n).select(
        "id", local_time("ts", tz).alias("time"), F.col("frameType").alias("type"),
        F.col("appName").alias("app"), F.length("fullOcrText").alias("full_chars"),
        F.length("ocrText").alias("ocr_chars"),
        F.when(F.col("isSummarized"), F.lit("yes")).otherwise(F.lit("no")).alias("summ"))


def recent_previews(captures: DataFrame, n: int = 10, chars: int = 80, tz: str = "UTC") -> DataFrame:
    return newest(captures, n).select(
        "id", local_time("ts", tz).alias("time"), F.col("frameType").alias("type"),
        F.col("appName").alias("app"), F.substring("fullOcrText", 1, chars).alias("text_preview"))


def capture_detail(captures: DataFrame, id: int | None = None, tz: str = "UTC") -> DataFrame:
    """Detail record of one capture (or, without an id, of every capture)."""
    rows = captures if id is None else captures.filter(F.col("id") == F.lit(id))
    return rows.select(
        "id", local_time("ts", tz).alias("time"), "appName", "appBundleID", "windowTitle", "frameType",
        "keyframeId", percent_text("changePercentage").alias("changePercent"),
        F.length("fullOcrText").alias("fullOcrTextLength"), F.length("ocrText").alias("ocrTextLength"),
        "isSummarized", "textHash", "fullOcrText",
        F.when(F.col("frameType") == "delta", F.col("ocrText")).alias("deltaText"))


def decode_windows(df: DataFrame, col: str = "visibleWindows", json: bool = False,
                   element: T.DataType | None = None, keep: list[str] = ("id",)) -> DataFrame:
    """One row per visible window. JSON text that is null or broken gives none."""
    value = S.decode_json_array(F.col(col), element or S.WINDOWS.elementType) if json else F.col(col)
    return df.select(*keep, F.posexplode(value).alias("position", "window")).select(*keep, "position", "window.*")


def capture_row_preview(captures: DataFrame, chars: int = 150) -> DataFrame:
    return captures.select(
        "id", F.when(is_keyframe(), F.lit("K")).otherwise(F.lit("D")).alias("badge"), "appName", "windowTitle",
        preview("ocrText", chars).alias("text_preview"), F.length("ocrText").alias("ocr_chars"),
        F.length("fullOcrText").alias("full_chars"), whole_percent("changePercentage").alias("change_pct"))


def tail(captures: DataFrame, after_id: int | None = None, tz: str = "UTC") -> DataFrame:
    """Rows with an id above ``after_id`` (all rows without it), ascending."""
    rows = captures if after_id is None else captures.filter(F.col("id") > F.lit(after_id))
    return rows.select(
        "id", local_time("ts", tz).alias("time"), F.col("frameType").alias("type"), F.col("appName").alias("app"),
        F.coalesce("windowTitle", F.lit("")).alias("window"), F.length("fullOcrText").alias("chars")).orderBy("id")


def max_id(captures: DataFrame) -> DataFrame:
    return captures.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


# -- summaries ---------------------------------------------------------------


def summaries_overlapping(summaries: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    hit = (F.col("endTs") >= instant(start)) & (F.col("startTs") <= instant(end))
    return newest(summaries.filter(hit), limit, ts="startTs")


def recent_summaries(summaries: DataFrame, limit: int = 20) -> DataFrame:
    return newest(summaries, limit, ts="endTs")


def summary_listing(summaries: DataFrame, limit: int = 10, chars: int = 100, tz: str = "UTC") -> DataFrame:
    return recent_summaries(summaries, limit).select(
        "id", local_time("startTs", tz).alias("start"), local_time("endTs", tz).alias("end"),
        F.to_json("appNames").alias("apps"), F.substring("summary", 1, chars).alias("summary_preview"))


def decode_summary_arrays(df: DataFrame) -> DataFrame:
    """JSON text columns of a summaries dump to arrays; null or broken text gives ``[]``."""
    return (df.withColumn("captureIds", S.decode_json_array(F.col("captureIds"), T.LongType()))
            .withColumn("appNames", S.decode_json_array(F.col("appNames"), T.StringType()))
            .withColumn("keyTopics", S.decode_json_array(F.col("keyTopics"), T.StringType())))


def summary_row_preview(summaries: DataFrame, topics: int = 5) -> DataFrame:
    none = F.array().cast("array<string>")
    return summaries.select(
        "id", F.array_join(F.coalesce("appNames", none), ", ").alias("apps"),
        F.array_join(F.slice(F.coalesce("keyTopics", none), 1, topics), ", ").alias("topics"),
        F.size("captureIds").alias("captures"), "summary")
