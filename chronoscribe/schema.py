"""Schemas of the tables and of the result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOWS = T.ArrayType(T.StructType([
    T.StructField("appName", T.StringType()),
    T.StructField("windowTitle", T.StringType()),
]))

CAPTURES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("appName", T.StringType(), False),
    T.StructField("appBundleID", T.StringType()),
    T.StructField("windowTitle", T.StringType()),
    T.StructField("ocrText", T.StringType(), False),
    T.StructField("fullOcrText", T.StringType(), False),
    T.StructField("visibleWindows", WINDOWS),
    T.StructField("textHash", T.StringType(), False),
    T.StructField("isSummarized", T.BooleanType(), False),
    T.StructField("frameType", T.StringType(), False),
    T.StructField("keyframeId", T.LongType()),
    T.StructField("changePercentage", T.DoubleType(), False),
])

SUMMARIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("startTs", T.TimestampType(), False),
    T.StructField("endTs", T.TimestampType(), False),
    T.StructField("appNames", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType(), False),
    T.StructField("keyTopics", T.ArrayType(T.StringType())),
    T.StructField("captureIds", T.ArrayType(T.LongType()), False),
])

TOKEN_USAGE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("caller", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("inputTokens", T.LongType(), False),
    T.StructField("outputTokens", T.LongType(), False),
])

OBSERVATIONS = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("appName", T.StringType(), False),
    T.StructField("windowTitle", T.StringType()),
    T.StructField("changedFraction", T.DoubleType()),
    T.StructField("fullText", T.StringType(), False),
    T.StructField("changedText", T.StringType(), False),
])

CITATION = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("window_title", T.StringType()),
    T.StructField("relevant_text", T.StringType()),
    T.StructField("relevance_explanation", T.StringType()),
    T.StructField("source", T.StringType()),
])


def from_columns(df: DataFrame, mapping: dict[str, str | Column], schema: T.StructType) -> DataFrame:
    """Project any table onto ``schema``; columns without a mapping become null."""
    out = []
    for field in schema.fields:
        src = mapping.get(field.name)
        col = F.lit(None) if src is None else (F.col(src) if isinstance(src, str) else src)
        if src is not None and isinstance(field.dataType, T.ArrayType):
            out.append(col.alias(field.name))
        else:
            out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


def decode_json_array(col: Column, element: T.DataType) -> Column:
    """JSON text to an array; null, broken or non-array text gives an empty array."""
    kind = T.ArrayType(element)
    empty = F.array().cast(kind)
    parsed = F.from_json(col, kind)
    # A broken element leaves null members behind: the whole text counts as broken.
    ok = parsed.isNotNull() & ~F.exists(parsed, lambda x: x.isNull())
    return F.when(F.ltrim(col).startswith("[") & ok, parsed).otherwise(empty)
