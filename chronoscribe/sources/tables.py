"""Readers and writers of the three tables.

Rows lie in ``date=`` folders: captures and usage by their time, summaries by their end. Captures are sorted by
time inside files, so a time range reads only its days and its row groups. Retention drops whole folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe import schema as S
from chronoscribe.functions.clock import instant, local_time
from chronoscribe.functions.text import dedup_hash
from chronoscribe.operators.scan import newest
from chronoscribe.sources.folders import Pending, dates_of, drop_before

# Parquet, ORC and JSON files hold the tables; JSON keeps array columns as text.
FORMATS = ("parquet", "orc", "json")


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt != "json":
        df = spark.read.format(fmt).schema(schema).load(path)
        return df.drop("date") if "date" not in schema.names else df
    arrays = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, T.ArrayType)}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in arrays else f.dataType) for f in schema.fields])
    df = spark.read.schema(flat).json(path)
    for name, kind in arrays.items():
        df = df.withColumn(name, S.decode_json_array(F.col(name), kind.elementType))
    return df


def with_extra(schema: T.StructType, extra: T.StructType | None) -> T.StructType:
    return schema if extra is None else T.StructType([*schema.fields, *extra.fields])


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet", start=None, end=None,
                  extra: T.StructType | None = None, days: list | None = None) -> DataFrame:
    """Typed scan. ``start``/``end`` prune date folders beside the exact time predicate; ``days`` are the only folders to read."""
    schema = with_extra(S.CAPTURES, extra)
    if fmt == "json":
        df = _read(spark, path, schema, fmt)
    else:
        df = spark.read.format(fmt).schema(with_extra(schema, T.StructType([T.StructField("date", T.DateType())]))).load(path)
    dated = "date" in df.columns
    if days is not None:
        df = _of_days(df, days)
    if start is not None:
        df = df.filter(F.col("ts") >= instant(start))
        df = df.filter(F.col("date") >= F.to_date(instant(start))) if dated else df
    if end is not None:
        df = df.filter(F.col("ts") <= instant(end))
        df = df.filter(F.col("date") <= F.to_date(instant(end))) if dated else df
    return df.drop("date")


def _of_days(df: DataFrame, days) -> DataFrame:
    return df.filter(F.col("date").isin([F.lit(d) for d in sorted(days)]) if days else F.lit(False))


def read_summaries(spark: SparkSession, path: str, fmt: str = "parquet", days: list | None = None) -> DataFrame:
    """Typed scan; ``days`` (of the ends) are the only folders to read."""
    if days is None:
        return _read(spark, path, S.SUMMARIES, fmt)
    dated = with_extra(S.SUMMARIES, T.StructType([T.StructField("date", T.DateType())]))
    return _of_days(_read(spark, path, dated, fmt), days).drop("date")


def read_token_usage(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, S.TOKEN_USAGE, fmt)


def capture_records(frames: DataFrame) -> DataFrame:
    """Frames to table rows: not summarised yet, text hash filled in when absent."""
    out = frames.withColumn("isSummarized", F.lit(False))
    if "textHash" not in out.columns:
        out = out.withColumn("textHash", dedup_hash("fullOcrText"))
    return out


#: Rows of a day that one writer takes, about.
ROWS_PER_WRITER = 1_000_000


def _by_day(rows: DataFrame) -> DataFrame:
    """Rows of a day go to one writer, those of a large day to several, so that an append writes about as many files as it has days.
    The days are dealt to all partitions, since a file costs more than its few rows. The driver gets the counts of large days."""
    per_day = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    large = per_day.filter((F.col("n") > ROWS_PER_WRITER) & F.col("date").isNotNull()).collect()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.lit(1)
    if large:
        known = F.create_map(*[c for r in large for c in (F.lit(r["date"]), F.lit(-(-r["n"] // ROWS_PER_WRITER)))])
        parts = F.coalesce(known[F.col("date")], parts)
    part = F.pmod(F.xxhash64("id"), parts) if large and "id" in rows.columns else F.lit(0)
    return rows.repartition(least + sum(-(-r["n"] // ROWS_PER_WRITER) for r in large), "date", part)


def append_captures(frames: DataFrame, path: str, pending: str | None = None) -> None:
    """Append by day (see ``_by_day``). With ``pending`` the days are marked there before anything is written (see
    ``summarize_pending``)."""
    rows = capture_records(frames).withColumn("date", F.to_date("ts"))
    if pending is not None:
        Pending(frames.sparkSession, pending).open(dates_of(frames, "ts"))
    (_by_day(rows).sortWithinPartitions("date", "ts", "id")
     .write.mode("append").partitionBy("date").parquet(path))


def append_summaries(summaries: DataFrame, path: str, key: str | None = None) -> None:
    """Append by the day of the end; with ``key`` rows already present under the same key are left out (safe to repeat). A key's
    row has the same end each time, so only the days of the new rows are looked at."""
    spark = summaries.sparkSession
    dated = "endTs" in summaries.columns
    rows = summaries.withColumn("date", F.to_date("endTs")) if dated else summaries
    if key is not None:
        try:
            there = spark.read.parquet(path)
        except Exception as missing:  # first write
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        else:
            if dated and "date" in there.columns:
                there = there.filter(F.col("date").isin([F.to_date(F.lit(d)) for d in dates_of(summaries, "endTs")]))
            rows = rows.join(there.select(key), key, "left_anti")
    if dated:
        _by_day(rows).write.mode("append").partitionBy("date").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def append_token_usage(usage: DataFrame, path: str) -> None:
    _by_day(usage.select(*S.TOKEN_USAGE.names, F.to_date("ts").alias("date"))).write.mode("append").partitionBy("date").parquet(path)


def drop_captures(spark: SparkSession, path: str, now, days: float = 7.0) -> int:
    """Delete old captures of the stored table; their number."""
    return drop_before(spark, path, "ts", now, days)


def drop_summaries(spark: SparkSession, path: str, now, days: float = 7.0) -> int:
    """Delete summaries that ended long ago."""
    return drop_before(spark, path, "endTs", now, days)


def drop_token_usage(spark: SparkSession, path: str, now, days: float = 7.0) -> int:
    return drop_before(spark, path, "ts", now, days)


def export_json(captures: DataFrame, tz: str = "UTC", ordered: bool = False) -> DataFrame:
    """One JSON text per capture with the twelve exported columns; ``ordered`` sorts newest first."""
    windows = F.col("visibleWindows")
    if isinstance(captures.schema["visibleWindows"].dataType, T.ArrayType):
        windows = F.to_json(windows)
    rows = newest(captures, None) if ordered else captures
    return rows.select("id", F.to_json(F.struct(
        F.col("id"), local_time("ts", tz).alias("time"), "appName", "appBundleID", "windowTitle", "frameType",
        "keyframeId", "changePercentage", "ocrText", "fullOcrText", windows.alias("visibleWindows"),
        F.col("isSummarized").cast("int").alias("isSummarized")), {"ignoreNullFields": "false"}).alias("value"))


def write_export(captures: DataFrame, path: str, tz: str = "UTC", ordered: bool = False) -> None:
    export_json(captures, tz, ordered).select("value").write.mode("overwrite").text(path)


def storage_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and number of a table's files, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))


def encode_windows(col: str | Column) -> Column:
    return F.to_json(F.col(col) if isinstance(col, str) else col)
