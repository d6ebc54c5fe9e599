"""Registered queries and their SQL twins.

``queries()`` maps a name to a function of (session, folder); ``oracle_sql()``
maps the same name to SQL over the same tables. Both read whole tables.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe import schema as S
from chronoscribe.functions import clock, numbers, replies, text
from chronoscribe.operators import dedup, frames, joins, render, retention, scan, search, stats
from chronoscribe.operators import sequence as seq
from chronoscribe.plans import api, retrieve, summarize
from chronoscribe.plans.complete import Completion
from chronoscribe.params import Params
from chronoscribe.plans.prompts import Templates
from chronoscribe.session import scratch, ship
from chronoscribe.sources import tables, views
from chronoscribe.streaming import capture as cap_stream
from chronoscribe.streaming import chunks as chunk_stream
from chronoscribe.streaming import machine

SMALL = "/root/testdata/sf0.001"
START, END, NOW = "2024-01-05 00:00:00", "2024-01-25 00:00:00", "2024-01-30 12:00:00"
DOC_START, DOC_END, DOC_NOW = "2024-01-01 02:00:00", "2024-01-01 12:00:00", "2024-01-01 14:00:00"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark, __file__)
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the twins' clock
            return _plain(fn(spark, folder))

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return register


def _plain(df: DataFrame) -> DataFrame:
    """Zone-free times and 64-bit whole numbers, as the SQL side has them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


def _list(col: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(col).cast("array<string>"), sep)


# -- canonical tables, once for Spark (views) and once for SQL ----------------

events, documents, conversations = (
    views.captures_of_events, views.captures_of_documents, views.captures_of_conversations)
summaries, usage = views.summaries_of_documents, views.usage_of_orders

EV = """events_c AS (
  SELECT event_id AS id, ts, user_id AS device, event_type AS appName, CAST(NULL AS VARCHAR) AS appBundleID,
    CAST(NULL AS VARCHAR) AS windowTitle, props AS ocrText, props AS fullOcrText, props AS visibleWindows,
    sha256(props) AS textHash, event_id % 3 = 0 AS isSummarized,
    CASE WHEN value >= 250 THEN 'keyframe' ELSE 'delta' END AS frameType,
    CASE WHEN value < 250 THEN event_id - event_id % 10 END AS keyframeId, value / 500 AS changePercentage
  FROM events)"""
DC = """docs_c AS (
  SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS ts, source AS appName,
    CAST(NULL AS VARCHAR) AS appBundleID, lang AS windowTitle, text AS ocrText, text AS fullOcrText,
    CAST(NULL AS VARCHAR) AS visibleWindows, doc_id % 3 = 0 AS isSummarized, 'keyframe' AS frameType,
    CAST(NULL AS BIGINT) AS keyframeId, CAST(1.0 AS DOUBLE) AS changePercentage
  FROM documents)"""
CV = """conv_c AS (
  SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 2) AS ts,
    conv_id AS device, role AS appName, CAST(NULL AS VARCHAR) AS windowTitle, text AS ocrText, text AS fullOcrText,
    CASE WHEN role = 'user' THEN 'keyframe' ELSE 'delta' END AS frameType,
    CASE WHEN role <> 'user' THEN conv_id * 1000 END AS keyframeId,
    (length(text) % 100) / 100 AS changePercentage
  FROM conversations)"""
SM = """sums AS (
  SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS startTs,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60 + 300) AS endTs, source AS app, lang, text AS summary
  FROM documents)"""
US = """usages AS (
  SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS caller, o_orderstatus AS model,
    CAST(trunc(o_totalprice) AS BIGINT) AS inputTokens, o_custkey AS outputTokens
  FROM orders)"""
FMT = "'%Y-%m-%d %H:%M:%S'"


# -- scans, sources, sinks -----------------------------------------------------


_STORE = "id, ts, appName, appBundleID, windowTitle, ocrText, fullOcrText, textHash, false AS isSummarized, frameType, keyframeId, changePercentage"


def _captures_table(spark, d):
    """Events as a stored captures table, written in two batches."""
    path = scratch(spark, "captures")
    rows = S.from_columns(events(spark, d), {n: n for n in S.CAPTURES.names if n != "visibleWindows"}
                          | {"visibleWindows": F.lit(None).cast(S.WINDOWS)}, S.CAPTURES)
    for part in (F.col("id") % 3 == 0, F.col("id") % 3 != 0):
        tables.append_captures(rows.filter(part), path)
    return path


@query("append_captures", f"WITH {EV} SELECT {_STORE} FROM events_c")
def _(spark, d):
    return tables.read_captures(spark, _captures_table(spark, d)).drop("visibleWindows")


@query("read_captures", f"WITH {EV} SELECT {_STORE} FROM events_c WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def _(spark, d):
    # The date folders outside of the range are not read.
    return tables.read_captures(spark, _captures_table(spark, d), start=START, end=END).drop("visibleWindows")


@query("storage_size", f"WITH {EV} SELECT count(*) > 0 AS has_files, count(*) > 0 AS sums_up, count(*) AS captures FROM events_c")
def _(spark, d):
    path = _captures_table(spark, d)
    rows = spark.read.parquet(path)
    # The files, each once, as the scan sees them.
    seen = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).groupBy("f").agg(
        F.first("size").alias("size"), F.count(F.lit(1)).alias("n")).agg(F.sum("size").alias("seen"), F.count(F.lit(1)).alias("nf"), F.sum("n").alias("captures"))
    return tables.storage_size(spark, path).join(seen, F.lit(True)).select(
        ((F.col("files") > 0) & (F.col("files") == F.col("nf"))).alias("has_files"), (F.col("bytes") == F.col("seen")).alias("sums_up"), "captures")


@query("append_summaries", f"WITH {SM} SELECT id, startTs, endTs, app AS appNames, summary, lang || ',' || app AS keyTopics, CAST(id AS VARCHAR) AS captureIds FROM sums")
def _(spark, d):
    path = scratch(spark, "summaries")
    rows = S.from_columns(summaries(spark, d), {n: n for n in S.SUMMARIES.names}, S.SUMMARIES)
    tables.append_summaries(rows.filter("id % 2 = 0"), path, "id")
    tables.append_summaries(rows, path, "id")  # rows that are there already are left out
    return tables.read_summaries(spark, path).withColumns({c: _list(c) for c in ("appNames", "keyTopics", "captureIds")})


@query("append_token_usage", f"WITH {US} SELECT * FROM usages")
def _(spark, d):
    path = scratch(spark, "usage")
    rows = S.from_columns(usage(spark, d), {n: n for n in S.TOKEN_USAGE.names}, S.TOKEN_USAGE)
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 != 0):
        tables.append_token_usage(rows.filter(part), path)
    return tables.read_token_usage(spark, path)


@query("read_summaries", f"WITH {SM} SELECT id, startTs, endTs, app AS appNames, summary, lang || ',' || app AS keyTopics, CAST(id AS VARCHAR) AS captureIds FROM sums")
def _(spark, d):
    return S.from_columns(summaries(spark, d), {n: n for n in S.SUMMARIES.names}, S.SUMMARIES).withColumns(
        {c: _list(c) for c in ("appNames", "keyTopics", "captureIds")})


@query("read_token_usage", f"WITH {US} SELECT * FROM usages")
def _(spark, d):
    return S.from_columns(usage(spark, d), {n: n for n in S.TOKEN_USAGE.names}, S.TOKEN_USAGE)


@query("export_json", f"""WITH {DC} SELECT id, CAST(json_object('id', id, 'time', strftime(ts, {FMT}), 'appName', appName,
  'appBundleID', appBundleID, 'windowTitle', windowTitle, 'frameType', frameType, 'keyframeId', keyframeId,
  'changePercentage', changePercentage, 'ocrText', ocrText, 'fullOcrText', fullOcrText,
  'visibleWindows', visibleWindows, 'isSummarized', CAST(isSummarized AS INTEGER)) AS VARCHAR) AS value FROM docs_c""")
def _(spark, d):
    return tables.export_json(documents(spark, d))


@query("tail", f"""WITH {EV} SELECT id, strftime(ts, {FMT}) AS time, frameType AS type, appName AS app,
  coalesce(windowTitle, '') AS "window", length(fullOcrText) AS chars FROM events_c WHERE id > 0""")
def _(spark, d):
    return scan.tail(events(spark, d), 0)


@query("tail_start", "SELECT coalesce(max(event_id), 0) AS last_id FROM events")
def _(spark, d):
    return scan.max_id(events(spark, d))


# -- filters and projections -----------------------------------------------------

_C = "id, ts, device, appName, frameType, isSummarized, changePercentage"
_CL = _C.split(", ")


@query("captures_between", f"WITH {EV} SELECT {_C} FROM events_c WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def _(spark, d):
    return scan.captures_between(events(spark, d), START, END).select(*_CL)


@query("captures_between_latest", f"WITH {EV} SELECT {_C} FROM events_c WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY ts DESC, id DESC LIMIT 50")
def _(spark, d):
    return scan.captures_between(events(spark, d), START, END, 50).select(*_CL)


@query("captures_by_ids", f"WITH {DC} SELECT id, ts, appName, windowTitle, fullOcrText FROM docs_c WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    ids = views.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return scan.captures_by_ids(documents(spark, d), ids).select("id", "ts", "appName", "windowTitle", "fullOcrText")


@query("unsummarized_older_than", f"WITH {EV} SELECT {_C} FROM events_c WHERE NOT isSummarized AND ts <= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND ORDER BY ts, id LIMIT 500")
def _(spark, d):
    return scan.unsummarized_older_than(events(spark, d), NOW, limit=500).select(*_CL)


@query("unsummarized_backlog", f"WITH {EV} SELECT {_C} FROM events_c WHERE NOT isSummarized AND ts <= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND")
def _(spark, d):
    return scan.unsummarized_older_than(events(spark, d), NOW).select(*_CL)


@query("unsummarized_between", f"WITH {EV} SELECT {_C} FROM events_c WHERE NOT isSummarized AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def _(spark, d):
    return scan.unsummarized_between(events(spark, d), START, END).select(*_CL)


@query("last_text_hash", f"WITH {EV} SELECT device, arg_max(textHash, (ts, id)) AS textHash FROM events_c GROUP BY device")
def _(spark, d):
    return scan.last_text_hash(events(spark, d), ["device"])


@query("last_keyframe", f"WITH {EV} SELECT {_C} FROM events_c WHERE frameType = 'keyframe' QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, id DESC) = 1")
def _(spark, d):
    return scan.last_keyframe(events(spark, d), ["device"]).select(*_CL)


@query("keyframes_between", f"WITH {EV} SELECT {_C} FROM events_c WHERE frameType = 'keyframe' AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def _(spark, d):
    return scan.keyframes_between(events(spark, d), START, END).select(*_CL)


@query("deltas_of", f"WITH {EV} SELECT {_C}, keyframeId FROM events_c WHERE frameType = 'delta' AND keyframeId IN (SELECT id FROM events_c WHERE frameType = 'keyframe')")
def _(spark, d):
    c = events(spark, d)
    return scan.deltas_of(c, c.filter("frameType = 'keyframe'").select("id")).select(*_CL, "keyframeId")


@query("recent_captures", f"""WITH {EV} SELECT id, strftime(ts, {FMT}) AS time, frameType AS type, appName AS app,
  length(fullOcrText) AS full_chars, length(ocrText) AS ocr_chars, CASE WHEN isSummarized THEN 'yes' ELSE 'no' END AS summ
  FROM events_c ORDER BY ts DESC, id DESC LIMIT 10""")
def _(spark, d):
    return scan.recent_captures(events(spark, d))


@query("recent_previews", f"""WITH {CV} SELECT id, strftime(ts, {FMT}) AS time, frameType AS type, appName AS app,
  substr(fullOcrText, 1, 80) AS text_preview FROM conv_c ORDER BY ts DESC, id DESC LIMIT 10""")
def _(spark, d):
    return scan.recent_previews(conversations(spark, d))


@query("capture_detail", f"""WITH {EV} SELECT id, strftime(ts, {FMT}) AS time, appName, appBundleID, windowTitle, frameType,
  keyframeId, printf('%.1f%%', changePercentage * 100) AS changePercent, length(fullOcrText) AS fullOcrTextLength,
  length(ocrText) AS ocrTextLength, isSummarized, textHash, fullOcrText,
  CASE WHEN frameType = 'delta' THEN ocrText END AS deltaText FROM events_c""")
def _(spark, d):
    return scan.capture_detail(events(spark, d))


@query("decode_windows", "SELECT event_id AS id, CAST(0 AS BIGINT) AS position, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    e = events(spark, d).withColumn("windows", F.concat(F.lit("["), "visibleWindows", F.lit("]")))
    return scan.decode_windows(e, "windows", json=True, element=T.StructType([T.StructField("k", T.LongType())]))


@query("capture_row_preview", f"""WITH {CV} SELECT id, CASE WHEN frameType = 'keyframe' THEN 'K' ELSE 'D' END AS badge, appName,
  windowTitle, replace(substr(ocrText, 1, 150), chr(10), ' ') AS text_preview, length(ocrText) AS ocr_chars,
  length(fullOcrText) AS full_chars, CAST(trunc(changePercentage * 100) AS BIGINT) AS change_pct FROM conv_c""")
def _(spark, d):
    return scan.capture_row_preview(conversations(spark, d))


@query("summaries_overlapping", f"WITH {SM} SELECT id, startTs, endTs, summary FROM sums WHERE endTs >= TIMESTAMP '{DOC_START}' AND startTs <= TIMESTAMP '{DOC_END}'")
def _(spark, d):
    return scan.summaries_overlapping(summaries(spark, d), DOC_START, DOC_END).select("id", "startTs", "endTs", "summary")


@query("recent_summaries", f"WITH {SM} SELECT id, startTs, endTs, summary FROM sums ORDER BY endTs DESC, id DESC LIMIT 20")
def _(spark, d):
    return scan.recent_summaries(summaries(spark, d)).select("id", "startTs", "endTs", "summary")


@query("summary_listing", f"""WITH {SM} SELECT id, strftime(startTs, {FMT}) AS start, strftime(endTs, {FMT}) AS "end",
  '["' || app || '"]' AS apps, substr(summary, 1, 100) AS summary_preview FROM sums ORDER BY endTs DESC, id DESC LIMIT 10""")
def _(spark, d):
    return scan.summary_listing(summaries(spark, d))


@query("decode_summary_arrays", """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS captureIds,
  event_type AS appNames, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || '+' || CAST(user_id AS VARCHAR) END AS keyTopics FROM events""")
def _(spark, d):
    e = views.table(spark, d, "events")
    quoted = F.concat(F.lit('["'), "event_type", F.lit('"]'))
    raw = e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 5 == 0, F.lit("[broken")).otherwise(F.concat(F.lit("["), "event_id", F.lit("]"))).alias("captureIds"),
        quoted.alias("appNames"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(
            F.concat(F.lit('["'), "event_type", F.lit('","'), "user_id", F.lit('"]'))).alias("keyTopics"))
    out = scan.decode_summary_arrays(raw)
    return out.select("id", _list("captureIds").alias("captureIds"), _list("appNames").alias("appNames"),
                      _list("keyTopics", "+").alias("keyTopics"))


@query("summary_row_preview", f"WITH {SM} SELECT id, app AS apps, lang || ', ' || app AS topics, CAST(1 AS BIGINT) AS captures, summary FROM sums")
def _(spark, d):
    return scan.summary_row_preview(summaries(spark, d))


# -- statistics --------------------------------------------------------------------


@query("health", "SELECT 'ok' AS status, (SELECT count(*) FROM events) AS capture_count, (SELECT count(*) FROM documents) AS summary_count")
def _(spark, d):
    return api.health(events(spark, d), summaries(spark, d))


_TOK = """coalesce(CAST(sum(inputTokens) AS BIGINT), 0) AS inputTokens, coalesce(CAST(sum(outputTokens) AS BIGINT), 0) AS outputTokens,
  coalesce(CAST(sum(inputTokens) AS BIGINT), 0) / 1e6 AS inputMtok, coalesce(CAST(sum(outputTokens) AS BIGINT), 0) / 1e6 AS outputMtok"""


@query("token_usage_totals", f"WITH {US} SELECT {_TOK} FROM usages WHERE caller = '1-URGENT' AND ts >= TIMESTAMP '1998-01-01' - INTERVAL 31536000 SECOND")
def _(spark, d):
    return stats.token_usage_totals(usage(spark, d), "1998-01-01 00:00:00", "1-URGENT", 31_536_000.0)


@query("token_usage_by_caller", f"WITH {US} SELECT caller, {_TOK} FROM usages WHERE ts >= TIMESTAMP '1998-01-01' - INTERVAL 31536000 SECOND GROUP BY caller")
def _(spark, d):
    return stats.token_usage_totals(usage(spark, d), "1998-01-01 00:00:00", within=31_536_000.0)


@query("table_stats", f"""WITH {EV} SELECT count(*) AS captures, count(*) FILTER (frameType = 'keyframe') AS keyframes,
  count(*) FILTER (frameType = 'delta') AS deltas, count(*) FILTER (isSummarized) AS summarized,
  count(*) FILTER (NOT isSummarized) AS unsummarized, (SELECT count(*) FROM documents) AS summaries FROM events_c""")
def _(spark, d):
    return stats.table_stats(events(spark, d), summaries(spark, d))


@query("time_span", f"SELECT coalesce(strftime(min(ts), {FMT}), 'none') AS oldest, coalesce(strftime(max(ts), {FMT}), 'none') AS newest FROM events")
def _(spark, d):
    return stats.time_span(events(spark, d))


@query("top_apps", "SELECT event_type AS appName, count(*) AS captures, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return stats.top_apps(events(spark, d))


@query("captures_per_hour", f"SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS captures FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR GROUP BY 1")
def _(spark, d):
    return stats.captures_per_hour(events(spark, d), NOW)


@query("frame_type_stats", f"""WITH {CV}, a AS (SELECT count(*) FILTER (frameType = 'keyframe') AS k, count(*) FILTER (frameType = 'delta') AS n,
    avg(changePercentage) FILTER (frameType = 'delta') AS ch, sum(length(ocrText)) FILTER (frameType = 'keyframe') AS ks,
    sum(length(ocrText)) FILTER (frameType = 'delta') AS ds FROM conv_c)
  SELECT k AS keyframes, n AS deltas, CAST(trunc(ch * 100) AS BIGINT) AS avg_delta_change_pct,
    CAST(ks // k AS BIGINT) AS avg_keyframe_chars, CAST(ds // n AS BIGINT) AS avg_delta_chars,
    CAST(trunc(100 - CAST(ds // n AS DOUBLE) / (ks // k) * 100) AS BIGINT) AS compression_pct FROM a""")
def _(spark, d):
    return stats.frame_type_stats(conversations(spark, d))


@query("summarization_progress", f"WITH {EV} SELECT count(*) FILTER (isSummarized) AS summarized, count(*) FILTER (NOT isSummarized) AS pending, count(*) FILTER (isSummarized) / count(*) AS progress FROM events_c")
def _(spark, d):
    return stats.summarization_progress(events(spark, d))


@query("text_size_stats", f"WITH {CV} SELECT frameType, count(*) AS rows, CAST(trunc(avg(length(ocrText))) AS BIGINT) AS avg_ocr_chars, CAST(trunc(avg(length(fullOcrText))) AS BIGINT) AS avg_full_chars FROM conv_c GROUP BY 1")
def _(spark, d):
    return stats.text_size_stats(conversations(spark, d))


_KDC = f"""WITH {EV} SELECT k.id, strftime(k.ts, {FMT}) AS time, k.appName AS app, count(c.id) AS deltas,
  substr(any_value(k.fullOcrText), 1, 80) AS text_preview
  FROM events_c k LEFT JOIN events_c c ON c.keyframeId = k.id WHERE k.frameType = 'keyframe' GROUP BY k.id, k.ts, k.appName"""


@query("keyframe_delta_counts", _KDC + " ORDER BY k.ts DESC, k.id DESC LIMIT 20")
def _(spark, d):
    return stats.keyframe_delta_counts(events(spark, d))


@query("keyframe_delta_counts_all", _KDC)
def _(spark, d):
    return stats.keyframe_delta_counts(events(spark, d), k=None)


@query("format_tokens", f"""WITH {US} SELECT id, CASE WHEN inputTokens * 20 < 1000 THEN CAST(inputTokens * 20 AS VARCHAR)
  WHEN inputTokens * 20 < 1000000 THEN printf('%.1fk', inputTokens * 20 / 1e3) ELSE printf('%.2fM', inputTokens * 20 / 1e6) END AS tokens,
  CASE WHEN outputTokens < 1000 THEN CAST(outputTokens AS VARCHAR) ELSE printf('%.1fk', outputTokens / 1e3) END AS out_tokens FROM usages""")
def _(spark, d):
    return usage(spark, d).select("id", numbers.format_tokens(F.col("inputTokens") * 20).alias("tokens"),
                                  numbers.format_tokens("outputTokens").alias("out_tokens"))


# -- state change and retention ---------------------------------------------------------


@query("mark_summarized", f"WITH {DC} SELECT id, ts, isSummarized OR id IN (SELECT doc_id FROM labels WHERE quality = 1) AS isSummarized FROM docs_c")
def _(spark, d):
    ids = views.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return retention.mark_summarized(documents(spark, d), ids).select("id", "ts", "isSummarized")


@query("unsummarized", f"WITH {EV} SELECT {_C} FROM events_c WHERE id NOT IN (SELECT doc_id FROM documents)")
def _(spark, d):
    return retention.unsummarized(events(spark, d), summaries(spark, d)).select(*_CL)


@query("prune_captures", f"WITH {EV} SELECT {_C} FROM events_c WHERE NOT ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def _(spark, d):
    return retention.prune_captures(events(spark, d), NOW).select(*_CL)


@query("prune_summaries", f"WITH {SM} SELECT id, startTs, endTs FROM sums WHERE NOT endTs < TIMESTAMP '2024-01-08 06:00:00' - INTERVAL 7 DAY")
def _(spark, d):
    return retention.prune_summaries(summaries(spark, d), "2024-01-08 06:00:00").select("id", "startTs", "endTs")


@query("prune_token_usage", f"WITH {US} SELECT * FROM usages WHERE NOT ts < TIMESTAMP '1998-06-01' - INTERVAL 90 DAY")
def _(spark, d):
    return retention.prune_token_usage(usage(spark, d), "1998-06-01 00:00:00", 90)


@query("pruned_count", f"SELECT count(*) AS deleted FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def _(spark, d):
    return retention.pruned_count(events(spark, d), NOW)


def _stored_copy(spark, name, rows, append):
    path = scratch(spark, name)
    append(rows, path)
    return path


@query("drop_captures", f"""WITH {EV} SELECT id, ts, appName, (SELECT count(*) FROM events_c WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS deleted
  FROM events_c WHERE NOT ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY""")
def _(spark, d):
    path = _stored_copy(spark, "captures", events(spark, d).drop("isSummarized"), tables.append_captures)
    deleted = tables.drop_captures(spark, path, NOW)
    return tables.read_captures(spark, path).select("id", "ts", "appName", F.lit(deleted).cast("long").alias("deleted"))


@query("drop_summaries", f"""WITH {SM} SELECT id, startTs, endTs, (SELECT count(*) FROM sums WHERE endTs < TIMESTAMP '2024-01-08 06:00:00' - INTERVAL 7 DAY) AS deleted
  FROM sums WHERE NOT endTs < TIMESTAMP '2024-01-08 06:00:00' - INTERVAL 7 DAY""")
def _(spark, d):
    rows = S.from_columns(summaries(spark, d), {n: n for n in S.SUMMARIES.names}, S.SUMMARIES)
    path = _stored_copy(spark, "summaries", rows, tables.append_summaries)
    deleted = tables.drop_summaries(spark, path, "2024-01-08 06:00:00")
    return tables.read_summaries(spark, path).select("id", "startTs", "endTs", F.lit(deleted).cast("long").alias("deleted"))


@query("drop_token_usage", f"""WITH {US} SELECT id, ts, caller, (SELECT count(*) FROM usages WHERE ts < TIMESTAMP '1998-06-01' - INTERVAL 90 DAY) AS deleted
  FROM usages WHERE NOT ts < TIMESTAMP '1998-06-01' - INTERVAL 90 DAY""")
def _(spark, d):
    rows = S.from_columns(usage(spark, d), {n: n for n in S.TOKEN_USAGE.names}, S.TOKEN_USAGE)
    path = _stored_copy(spark, "usage", rows, tables.append_token_usage)
    deleted = tables.drop_token_usage(spark, path, "1998-06-01 00:00:00", 90)
    return tables.read_token_usage(spark, path).select("id", "ts", "caller", F.lit(deleted).cast("long").alias("deleted"))


# -- text and duplicates -----------------------------------------------------------------

WS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{WS}', ' ', 'g'))"


def _words(c: str) -> str:
    n = _norm(c)
    return f"CASE WHEN {n} = '' THEN [] ELSE list_distinct(string_split({n}, ' ')) END"


@query("normalize_text", f"SELECT doc_id AS id, {_norm('text')} AS normalized FROM documents")
def _(spark, d):
    return documents(spark, d).select("id", text.normalize_text("fullOcrText").alias("normalized"))


@query("text_hash", f"SELECT doc_id AS id, sha256(text) AS raw_hash, sha256({_norm('text')}) AS dedup_hash FROM documents")
def _(spark, d):
    return documents(spark, d).select("id", text.text_hash("fullOcrText").alias("raw_hash"),
                                      text.dedup_hash("fullOcrText").alias("dedup_hash"))


@query("dedup_consecutive", f"""WITH {DC}, h AS (SELECT id, ts, appName, windowTitle, sha256({_norm('fullOcrText')}) AS h FROM docs_c)
  SELECT id, ts, appName FROM h QUALIFY lag(h) OVER (PARTITION BY windowTitle ORDER BY ts, id) IS DISTINCT FROM h""")
def _(spark, d):
    return dedup.dedup_consecutive(documents(spark, d), ["windowTitle"]).select("id", "ts", "appName")


@query("dedup_consecutive_hash", f"""WITH {EV} SELECT id, ts, device, appName FROM events_c
  QUALIFY lag(appName) OVER (PARTITION BY device ORDER BY ts, id) IS DISTINCT FROM appName""")
def _(spark, d):
    return dedup.dedup_consecutive(events(spark, d), ["device"], hash="appName").select("id", "ts", "device", "appName")


_PAIR = f"""WITH {DC}, w AS (SELECT id, windowTitle, ts, {_words('fullOcrText')} AS ws, sha256({_norm('fullOcrText')}) AS h FROM docs_c),
  p AS (SELECT id, ws, h, lag(ws) OVER x AS pw, lag(h) OVER x AS ph FROM w WINDOW x AS (PARTITION BY windowTitle ORDER BY ts, id)),
  s AS (SELECT *, len(list_intersect(ws, pw)) AS c FROM p),
  j AS (SELECT id, h, ph, CASE WHEN pw IS NULL THEN NULL WHEN len(ws) = 0 AND len(pw) = 0 THEN 1.0
    ELSE CAST(c AS DOUBLE) / (len(ws) + len(pw) - c) END AS s FROM s)"""


def _compared(spark, d):
    return documents(spark, d).select("id", "ts", "windowTitle", "fullOcrText")


@query("jaccard_similarity", _PAIR + " SELECT id, round(s, 9) AS similarity FROM j")
def _(spark, d):
    return dedup.compare_with_previous(_compared(spark, d), ["windowTitle"]).select("id", F.round("similarity", 9).alias("similarity"))


_SEEN = _PAIR + """, r AS (SELECT h, min(coalesce(id, -9223372036854775808)) AS o, any_value(ws) AS ws FROM w WHERE h IS NOT NULL GROUP BY h),
  t AS (SELECT h, unnest(ws) AS word FROM r), f AS (SELECT word, count(*) AS f FROM t GROUP BY word),
  k AS (SELECT h, word, row_number() OVER (PARTITION BY h ORDER BY f, word) AS k, count(*) OVER (PARTITION BY h) AS n FROM t JOIN f USING (word)),
  x AS (SELECT h, word FROM k WHERE k <= n - ceil(0.9 * n - 1e-9) + 1),
  q AS (SELECT DISTINCT a.h, b.h AS other FROM x a JOIN x b USING (word) WHERE a.h <> b.h),
  m AS (SELECT y.h, y.ws, z.ws AS pw, len(list_intersect(y.ws, z.ws)) AS c FROM q JOIN r y ON y.h = q.h JOIN r z ON z.h = q.other AND z.o < y.o),
  near AS (SELECT DISTINCT h, true AS near FROM m WHERE CAST(c AS DOUBLE) / (len(ws) + len(pw) - c) >= CAST(0.9 AS DOUBLE))"""


@query("near_duplicates", _SEEN + """ SELECT j.id, coalesce(j.h = j.ph OR j.s >= 0.3, false) AS "nearDuplicate",
  coalesce(coalesce(j.id, -9223372036854775808) > r.o OR coalesce(near.near, false), false) AS "seenBefore"
  FROM j LEFT JOIN r ON r.h = j.h LEFT JOIN near ON near.h = j.h""")
def _(spark, d):
    # Each row against the one before it, and against all earlier rows of the table.
    pairs = dedup.compare_with_previous(_compared(spark, d), ["windowTitle"], threshold=0.3)
    return dedup.near_duplicates(pairs, ["ts", "id"], threshold=0.9).select("id", "nearDuplicate", "seenBefore")


# -- sequences -----------------------------------------------------------------------------

WALK = """walk AS (SELECT *, sum(CAST(frameType = 'keyframe' AS INTEGER)) OVER (PARTITION BY device ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS kn FROM conv_c),
  grouped AS (SELECT *, CASE WHEN kn = 0 THEN id ELSE first_value(id) OVER (PARTITION BY device, kn ORDER BY ts, id) END AS groupId,
    kn = 0 OR frameType = 'keyframe' AS isHead FROM walk)"""


@query("group_captures", f"WITH {CV}, {WALK} SELECT id, device, groupId, isHead FROM grouped")
def _(spark, d):
    return seq.group_captures(conversations(spark, d), ["device"]).select("id", "device", "groupId", "isHead")


@query("group_members", f"""WITH {CV}, {WALK} SELECT id, groupId, row_number() OVER (PARTITION BY device, groupId ORDER BY ts, id) AS position,
  count(*) OVER (PARTITION BY device, groupId) AS groupSize FROM grouped""")
def _(spark, d):
    g = seq.group_captures(conversations(spark, d), ["device"])
    return seq.group_members(g, ["device"]).select("id", "groupId", "position", "groupSize")


@query("capture_groups", f"""WITH {EV}, r AS (SELECT e.*, p.id AS pid FROM events_c e LEFT JOIN events_c p ON e.frameType = 'delta' AND e.keyframeId = p.id
    WHERE e.ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
  n AS (SELECT *, count(*) FILTER (frameType = 'keyframe' OR pid IS NOT NULL) OVER (PARTITION BY device ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS sn FROM r),
  b AS (SELECT *, CASE WHEN frameType = 'keyframe' THEN id WHEN sn = 1 AND pid IS NOT NULL THEN pid END AS cur FROM n)
  SELECT id, device, coalesce(last_value(cur IGNORE NULLS) OVER w, id) AS groupId,
    coalesce(last_value(CASE WHEN cur IS NOT NULL THEN frameType <> 'keyframe' END IGNORE NULLS) OVER w, false) AS parentOutside
  FROM b WINDOW w AS (PARTITION BY device ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return seq.capture_groups(events(spark, d), START, END, ["device"]).select("id", "device", "groupId", "parentOutside")


def _windows(src: str, width: int, key: str = "device") -> str:
    return f"""w AS (SELECT {key}, min(ts) AS windowStart FROM {src} GROUP BY {key}
    UNION ALL SELECT w.{key}, min(c.ts) FROM w JOIN {src} c ON c.{key} = w.{key} AND c.ts >= w.windowStart + INTERVAL {width} SECOND GROUP BY w.{key}),
  windowed AS (SELECT c.*, w.windowStart FROM {src} c ASOF JOIN w ON c.{key} = w.{key} AND c.ts >= w.windowStart)"""


@query("chunk_by_time", f"WITH RECURSIVE {EV}, {_windows('events_c', 86400)} SELECT id, device, windowStart FROM windowed")
def _(spark, d):
    return seq.chunk_by_time(events(spark, d).select("id", "ts", "device"), ["device"], 86_400).select("id", "device", "windowStart")


@query("chunk_by_time_one_sequence", f"""WITH RECURSIVE {EV}, e1 AS (SELECT id, ts, 0 AS k FROM events_c), {_windows('e1', 21600, 'k')}
  SELECT id, windowStart FROM windowed""")
def _(spark, d):
    return seq.chunk_by_time(events(spark, d).select("id", "ts"), [], 21_600, cut=True).select("id", "windowStart")


@query("chunk_by_app_switch", f"""WITH {EV}, f AS (SELECT *, lag(appName) OVER (PARTITION BY device ORDER BY ts, id) IS DISTINCT FROM appName AS new FROM events_c),
  g AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY device ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM f)
  SELECT id, device, first_value(id) OVER (PARTITION BY device, n ORDER BY ts, id) AS chunkId FROM g""")
def _(spark, d):
    return seq.chunk_by_app_switch(events(spark, d), ["device"]).select("id", "device", "chunkId")


def _hybrid(src: str, width: int, minimum: int) -> str:
    return f"""{_windows(src, width)},
  isl AS (SELECT *, lag(windowStart) OVER o IS DISTINCT FROM windowStart AS opens,
      lag(appName) OVER o IS DISTINCT FROM appName AS sw FROM windowed WINDOW o AS (PARTITION BY device ORDER BY ts, id)),
  isn AS (SELECT *, count(*) FILTER (opens OR sw) OVER (PARTITION BY device ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS i FROM isl),
  ext AS (SELECT *, epoch_us(max(ts) OVER (PARTITION BY device, i)) - epoch_us(min(ts) OVER (PARTITION BY device, i)) AS dur,
      row_number() OVER (PARTITION BY device, i ORDER BY ts, id) = 1 AS first FROM isn),
  mrg AS (SELECT *, count(*) FILTER (first AND (opens OR dur >= {minimum * 1000000})) OVER (PARTITION BY device ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS m FROM ext),
  hybrid AS (SELECT *, first_value(id) OVER (PARTITION BY device, m ORDER BY ts, id) AS chunkId FROM mrg)"""


@query("chunk_hybrid", f"WITH RECURSIVE {EV}, {_hybrid('events_c', 86400, 3600)} SELECT id, device, windowStart, chunkId FROM hybrid")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "appName")
    return seq.chunk_hybrid(rows, ["device"], 86_400, 3_600).select("id", "device", "windowStart", "chunkId")


@query("chunk_hybrid_sliced", f"WITH RECURSIVE {EV}, {_hybrid('events_c', 86400, 3600)} SELECT id, device, windowStart, chunkId FROM hybrid")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "appName")
    return seq.chunk_hybrid(rows, ["device"], 86_400, 3_600, cut=True).select("id", "device", "windowStart", "chunkId")


@query("merge_short_chunks", f"""WITH {EV}, f AS (SELECT *, lag(appName) OVER (PARTITION BY device ORDER BY ts, id) IS DISTINCT FROM appName AS new FROM events_c),
  g AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY device ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM f),
  c AS (SELECT device, arg_min(id, (ts, id)) AS chunkId, min(ts) AS startTs, max(ts) AS endTs FROM g GROUP BY device, n),
  o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY startTs, chunkId) AS one FROM c),
  m AS (SELECT *, count(*) FILTER (one = 1 OR endTs - startTs >= INTERVAL 7200 SECOND) OVER (PARTITION BY device ORDER BY one ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT device, chunkId, first_value(chunkId) OVER (PARTITION BY device, k ORDER BY one) AS mergedId FROM m""")
def _(spark, d):
    c = seq.chunk_by_app_switch(events(spark, d), ["device"])
    chunks = c.groupBy("device", "chunkId").agg(F.min("ts").alias("startTs"), F.max("ts").alias("endTs"))
    return seq.merge_short_chunks(chunks, ["device"], 7_200).select("device", "chunkId", "mergedId")


FEATURES = """feat AS (SELECT device, chunkId, min(ts) AS startTs, max(ts) AS endTs, count(*) AS captureCount,
    string_agg(DISTINCT appName, ',' ORDER BY appName) AS appNames, arg_max(coalesce(windowTitle, '-'), (ts, id)) AS title,
    string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts, id) AS captureIds FROM hybrid GROUP BY device, chunkId),
  apps AS (SELECT device, chunkId, appName, count(*) AS n FROM hybrid GROUP BY ALL),
  prime AS (SELECT device, chunkId, appName AS primaryApp FROM apps QUALIFY row_number() OVER (PARTITION BY device, chunkId ORDER BY n DESC, appName) = 1)"""


@query("chunk_features", f"""WITH RECURSIVE {EV}, {_hybrid('events_c', 86400, 3600)}, {FEATURES}
  SELECT device, chunkId, startTs, endTs, captureCount, primaryApp, appNames, captureIds FROM feat JOIN prime USING (device, chunkId)""")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "appName", "windowTitle")
    c = seq.chunk_hybrid(rows, ["device"], 86_400, 3_600)
    return seq.chunk_features(c, ["device"]).withColumns({x: _list(x) for x in ("appNames", "captureIds")}).drop("primaryWindowTitle")


def _spaced(index: str, count: str, k: int) -> str:
    if k == 1:
        return f"({count} <= 1 OR {index} = 0)"
    return f"({count} <= {k} OR list_contains(list_transform(range({k}), lambda i: CAST(trunc(i * (CAST({count} - 1 AS DOUBLE) / {k - 1})) AS BIGINT)), {index}))"


@query("evenly_spaced", f"""WITH {EV}, p AS (SELECT id, device, row_number() OVER (PARTITION BY device ORDER BY ts, id) - 1 AS r, count(*) OVER (PARTITION BY device) AS n FROM events_c)
  SELECT id, device FROM p WHERE {_spaced('r', 'n', 12)}""")
def _(spark, d):
    return seq.evenly_spaced(events(spark, d), 12, ["device"]).select("id", "device")


@query("truncate_text", "SELECT doc_id AS id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS short FROM documents")
def _(spark, d):
    return documents(spark, d).select("id", text.truncate_text("fullOcrText", 500).alias("short"))


def _sections(src: str, part: str, max_kf: int, max_d: int, kf_chars: int, d_chars: int) -> str:
    """CTEs from rows ``src`` to ``rendered(part, text)``."""
    cut = "CASE WHEN length(ocrText) > {0} THEN substr(ocrText, 1, {0}) || '...' ELSE ocrText END"
    return f"""s1 AS (SELECT *, count(*) FILTER (frameType = 'keyframe') OVER (PARTITION BY {part} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS kn0 FROM {src}),
  s2 AS (SELECT *, kn0 = 0 OR frameType = 'keyframe' AS head FROM s1),
  s3 AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY {part} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS g,
    count(*) FILTER (head) OVER (PARTITION BY {part}) AS gn FROM s2),
  s4 AS (SELECT *, row_number() OVER (PARTITION BY {part}, g ORDER BY ts, id) - 2 AS dx, count(*) FILTER (NOT head) OVER (PARTITION BY {part}, g) AS dn FROM s3),
  s5 AS (SELECT *, CASE WHEN head THEN '--- Keyframe (' || strftime(ts, '%H:%M:%S') || ') [' || appName || ' — ' || coalesce(windowTitle, 'Unknown') || '] ---' || chr(10) || {cut.format(kf_chars)}
      WHEN ocrText <> '' THEN '--- Delta (' || strftime(ts, '%H:%M:%S') || ') [' || CAST(CAST(trunc(changePercentage * 100) AS BIGINT) AS VARCHAR) || '% changed] ---' || chr(10) || {cut.format(d_chars)} END AS section
    FROM s4 WHERE {_spaced('g - 1', 'gn', max_kf)} AND (head OR {_spaced('dx', 'dn', max_d)})),
  rendered AS (SELECT {part}, string_agg(section, chr(10) || chr(10) ORDER BY ts, id) AS text FROM s5 GROUP BY {part})"""


@query("format_hierarchical", f"WITH {CV}, {_sections('conv_c', 'device', 2, 1, 300, 100)} SELECT device, text FROM rendered")
def _(spark, d):
    return render.format_hierarchical(conversations(spark, d), ["device"], 2, 1, 300, 100)


@query("format_hierarchical_sliced", f"WITH {CV}, {_sections('conv_c', 'device', 2, 1, 300, 100)} SELECT device, text FROM rendered")
def _(spark, d):
    return render.format_hierarchical(conversations(spark, d), ["device"], 2, 1, 300, 100, cut=True)


@query("summary_prompts", f"""WITH RECURSIVE {CV}, {_hybrid('conv_c', 6, 1)}, {FEATURES}, {_sections('hybrid', 'device, chunkId', 10, 3, 2000, 300)}
  SELECT device, chunkId, 'At ' || strftime(startTs, '%H:%M:%S') || '-' || strftime(endTs, '%H:%M:%S') || ' for ' ||
    CAST((epoch_us(endTs) - epoch_us(startTs)) // 1000000 AS VARCHAR) || 's in ' || primaryApp || ' (Unknown):' || chr(10) || text AS prompt
  FROM feat JOIN prime USING (device, chunkId) JOIN rendered USING (device, chunkId)""")
def _(spark, d):
    tpl = Templates(summary_user="At {start_time}-{end_time} for {duration} in {app_name} ({window_title}):\n{ocr_samples}")
    # Short windows, so that short conversations give several chunks.
    chunked = seq.chunk_hybrid(conversations(spark, d), ["device"], 6, 1)
    return summarize.prompts_of_chunks(chunked, ["device"], Params(), tpl).select("device", "chunkId", "prompt")


# -- joins and unions --------------------------------------------------------------------------


@query("summaries_in_ranges", f"""WITH {SM}, placed AS (SELECT o_orderkey, o_custkey * 977 % (SELECT max(doc_id) * 60 + 600 FROM documents) AS p FROM orders),
  ranges AS (SELECT o_orderkey AS range_id, TIMESTAMP '2024-01-01' + to_seconds(p) AS a,
    TIMESTAMP '2024-01-01' + to_seconds(p + CASE WHEN o_orderkey % 2000 = 0 THEN 100000000 WHEN o_orderkey % 50 = 3 THEN -30 ELSE 60 + o_orderkey % 600 END) AS b FROM placed)
  SELECT range_id, id FROM sums JOIN ranges ON endTs >= a AND startTs <= b""")
def _(spark, d):
    o = views.table(spark, d, "orders")
    # Ranges over the time of all summaries; some span years, some end before they start.
    last = summaries(spark, d).agg(F.max("id") * 60 + 600).scalar()
    o = o.withColumn("at", F.col("o_custkey") * 977 % last)
    length = F.when(F.col("o_orderkey") % 2000 == 0, 100_000_000).when(F.col("o_orderkey") % 50 == 3, -30).otherwise(60 + F.col("o_orderkey") % 600)
    ranges = o.select(F.col("o_orderkey").alias("range_id"), views._at(F.col("at")).alias("start"), views._at(F.col("at") + length).alias("end"))
    return joins.summaries_in_ranges(summaries(spark, d), ranges).select("range_id", "id")


@query("resolve_captures", f"""WITH {SM}, {EV}, newest AS (SELECT id FROM sums ORDER BY startTs DESC, id DESC)
  SELECT {_C} FROM events_c WHERE id IN (SELECT id FROM newest WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1))""")
def _(spark, d):
    relevant = views.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return joins.resolve_captures(events(spark, d), summaries(spark, d), relevant).select(*_CL)


@query("with_parent", f"""WITH {EV} SELECT c.id, c.keyframeId, p.id AS parent_id, p.ts AS parent_ts, p.appName AS parent_appName, p.ocrText AS parent_ocrText
  FROM events_c c LEFT JOIN events_c p ON c.keyframeId = p.id WHERE c.frameType = 'delta'""")
def _(spark, d):
    return joins.with_parent(events(spark, d)).select("id", "keyframeId", "parent_id", "parent_ts", "parent_appName", "parent_ocrText")


@query("ordered_union_distinct", """SELECT id, min(priority) AS priority FROM (SELECT doc_id AS id, 0 AS priority FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 1 FROM labels UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY id""")
def _(spark, d):
    lab = views.table(spark, d, "labels")
    parts = [lab.filter("quality = 1").select(F.col("doc_id").alias("id")), lab.select(F.col("doc_id").alias("id")),
             documents(spark, d).select("id")]
    return joins.ordered_union_distinct(parts)


@query("merge_candidates", f"WITH {DC} SELECT id, ts, appName FROM docs_c WHERE id IN (SELECT doc_id FROM labels) OR NOT isSummarized ORDER BY ts DESC, id DESC LIMIT 50")
def _(spark, d):
    c = documents(spark, d).select("id", "ts", "appName", "isSummarized")
    lab = views.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return joins.merge_candidates(c.join(lab, "id", "left_semi"), c.filter(~F.col("isSummarized"))).select("id", "ts", "appName")


# -- frame machine --------------------------------------------------------------------------------

OBS = """obs AS (SELECT CAST(conv_id AS VARCHAR) AS device, conv_id * 1000 + turn AS id, turn, role AS app, (length(text) % 8) / 10 AS ch,
    """ + _norm("text") + """ AS norm, text, turn * 20 AS sec,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
  run AS (
    SELECT device, rn, id, 'keyframe' AS decision, 'first' AS reason, true AS stored, norm AS last, norm AS kfn, text AS kft, app AS kfa, sec AS kfs, id AS kfi,
      text AS ot, text AS ft, CAST(NULL AS BIGINT) AS ki, CAST(1.0 AS DOUBLE) AS cp FROM obs WHERE rn = 1
    UNION ALL
    SELECT device, rn, id, decision, reason, stored,
      CASE WHEN stored THEN cand ELSE last END, CASE WHEN stored AND decision = 'keyframe' THEN norm ELSE kfn END,
      CASE WHEN stored AND decision = 'keyframe' THEN text ELSE kft END, CASE WHEN stored AND decision = 'keyframe' THEN app ELSE kfa END,
      CASE WHEN stored AND decision = 'keyframe' THEN sec ELSE kfs END, CASE WHEN stored AND decision = 'keyframe' THEN id ELSE kfi END,
      CASE WHEN stored THEN text END, CASE WHEN stored THEN CASE WHEN decision = 'keyframe' THEN text ELSE kft || chr(10) || text END END,
      CASE WHEN stored AND decision = 'delta' THEN kfi END, CASE WHEN stored THEN ch END
    FROM (SELECT *, decision <> 'skip' AND cand <> last AS stored FROM (
      SELECT *, CASE WHEN decision = 'delta' THEN trim(kfn || ' ' || norm) ELSE norm END AS cand FROM (
        SELECT o.*, r.last, r.kfn, r.kft, r.kfa, r.kfs, r.kfi,
          CASE WHEN o.ch = 0 THEN 'skip' WHEN o.ch >= 0.5 OR o.app <> r.kfa OR o.sec - r.kfs >= 60 THEN 'keyframe' ELSE 'delta' END AS decision,
          CASE WHEN o.ch = 0 THEN 'unchanged' WHEN o.ch >= 0.5 THEN 'change' WHEN o.app <> r.kfa THEN 'app' WHEN o.sec - r.kfs >= 60 THEN 'time' ELSE 'change' END AS reason
        FROM run r JOIN obs o ON o.device = r.device AND o.rn = r.rn + 1))))"""


@query("classify_frames", f"WITH RECURSIVE {OBS} SELECT device, id, decision, reason, stored FROM run")
def _(spark, d):
    return machine.classify_frames(views.observations_of_conversations(spark, d)).select("device", "id", "decision", "reason", "stored")


@query("classify_frames_sliced", f"WITH RECURSIVE {OBS} SELECT device, id, decision, reason, stored FROM run")
def _(spark, d):
    return machine.classify_frames(views.observations_of_conversations(spark, d), cut=True, slices=16).select("device", "id", "decision", "reason", "stored")


# All turns as one sequence of one application.
OBS_ONE = (OBS.replace("CAST(conv_id AS VARCHAR) AS device", "'all' AS device").replace("role AS app", "'app' AS app")
           .replace("turn * 20 AS sec", "conv_id * 3600 + turn * 20 AS sec").replace("PARTITION BY conv_id ORDER BY turn", "ORDER BY conv_id, turn"))


@query("materialize_frames_one_sequence", f"""WITH RECURSIVE {OBS_ONE} SELECT id, ot AS ocrText, ft AS fullOcrText, sha256(last) AS textHash,
  decision AS frameType, ki AS keyframeId, cp AS changePercentage FROM run WHERE stored""")
def _(spark, d):
    rows = views.observations_of_conversations(spark, d).withColumn("appName", F.lit("app")).drop("device")
    return machine.materialize_frames(rows, [], cut=True, slices=32).select("id", "ocrText", "fullOcrText", "textHash", "frameType", "keyframeId", "changePercentage")


@query("materialize_frames", f"""WITH RECURSIVE {OBS} SELECT device, id, ot AS ocrText, ft AS fullOcrText, sha256(last) AS textHash,
  decision AS frameType, ki AS keyframeId, cp AS changePercentage FROM run WHERE stored""")
def _(spark, d):
    return machine.materialize_frames(views.observations_of_conversations(spark, d)).select(
        "device", "id", "ocrText", "fullOcrText", "textHash", "frameType", "keyframeId", "changePercentage")


@query("restore_state", f"""WITH {EV} SELECT device, arg_max(textHash, (ts, id)) AS lastHash, arg_max(id, (ts, id)) FILTER (frameType = 'keyframe') AS kfId,
  arg_max(ocrText, (ts, id)) FILTER (frameType = 'keyframe') AS kfText, arg_max(appName, (ts, id)) FILTER (frameType = 'keyframe') AS kfApp,
  max(ts) FILTER (frameType = 'keyframe') AS kfTs FROM events_c GROUP BY device""")
def _(spark, d):
    return machine.restore_state(events(spark, d), ["device"])


# -- search -----------------------------------------------------------------------------------------

TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{Co}}][\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}]*')"


def _tokens_sql(src: str, fields: list[str]) -> str:
    """CTEs ``tk`` (one row per token) and ``ln`` (tokens per row)."""
    parts = " UNION ALL ".join(
        f"SELECT id, {i} AS field, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT id, {TOK.format(f)} AS t FROM {src})"
        for i, f in enumerate(fields))
    lens = " + ".join(f"len({TOK.format(f)})" for f in fields)
    return f"tk AS ({parts}), ln AS (SELECT id, {lens} AS len FROM {src}), corpus AS (SELECT count(*) AS n, avg(len) AS mean FROM ln)"


def _rank_sql(phrases: list[list[str]]) -> str:
    """CTE ``ranked(id, rank)``; needs ``tk``, ``ln`` and ``corpus``."""
    hits = []
    for i, p in enumerate(phrases):
        joins_ = "".join(f" JOIN tk t{o} ON t{o}.id = t0.id AND t{o}.field = t0.field AND t{o}.pos = t0.pos + {o} AND t{o}.term = '{t}'"
                         for o, t in enumerate(p) if o)
        hits.append(f"SELECT {i} AS phrase, t0.id, count(*) AS tf FROM tk t0{joins_} WHERE t0.term = '{p[0]}' GROUP BY t0.id")
    return f"""tf AS ({' UNION ALL '.join(hits)}), pf AS (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase),
  ranked AS (SELECT tf.id, -sum(greatest_idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS rank
    FROM tf JOIN ln USING (id) JOIN (SELECT phrase, mean, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS greatest_idf FROM pf, corpus) USING (phrase)
    GROUP BY tf.id HAVING count(*) = {len(phrases)})"""


CAP_TOK = _tokens_sql("docs_c", ["fullOcrText", "windowTitle", "appName"])
SUM_TOK = _tokens_sql("sums", ["summary", "lang || ' ' || app", "app"])


@query("tokenize", f"SELECT doc_id AS id, len({TOK.format('text')}) AS tokens, md5(list_aggregate({TOK.format('text')}, 'string_agg', ' ')) AS digest FROM documents")
def _(spark, d):
    t = documents(spark, d).select("id", search.tokenize("fullOcrText", stem=False).alias("t"))
    return t.select("id", F.size("t").alias("tokens"), F.when(F.size("t") > 0, F.md5(F.array_join("t", " "))).alias("digest"))


def _index(spark, d):
    return _saved_index(spark, d, "captures")


@query("build_postings", f"WITH {DC}, {CAP_TOK} SELECT term, count(*) AS occurrences, count(DISTINCT id) AS rows, CAST(sum(pos - 1) AS BIGINT) AS positions FROM tk GROUP BY term")
def _(spark, d):
    postings = search.build_postings(documents(spark, d), {c: c for c in search.CAPTURE_FIELDS}, stem=False)
    # Two steps: a frequent term is first reduced to one row per document.
    per_row = postings.groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("p"))
    return per_row.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("rows"), F.sum("p").alias("positions"))


@query("document_lengths", f"WITH {DC}, {CAP_TOK} SELECT id, len FROM ln")
def _(spark, d):
    return search.document_lengths(documents(spark, d), {c: c for c in search.CAPTURE_FIELDS})


_PHRASES = [["of", "the"], ["the", "the"], ["in"], ["es", "src1"]]


@query("phrase_match", f"WITH {DC}, {CAP_TOK}, {_rank_sql(_PHRASES)} SELECT id, CAST(phrase AS BIGINT) AS phrase, tf FROM tf")
def _(spark, d):
    return _index(spark, d).occurrences(_PHRASES).select("id", F.col("phrase").cast("long").alias("phrase"), "tf")


def _q(text_: str) -> list[list[str]]:
    return search.parse_query(text_, stem=False)


@query("bm25_rank", f"WITH {DC}, {CAP_TOK}, {_rank_sql(_q('the en of-the'))} SELECT id, round(rank, 9) AS rank FROM ranked")
def _(spark, d):
    return _index(spark, d).rank(_q("the en of-the")).select("id", F.round("rank", 9).alias("rank"))


@query("bm25_rank_scan", f"WITH {DC}, {CAP_TOK}, {_rank_sql(_q('that is was'))} SELECT id, round(rank, 9) AS rank FROM ranked")
def _(spark, d):
    return search.rank_documents(documents(spark, d), search.CAPTURE_FIELDS, _q("that is was"), stem=False).select(
        "id", F.round("rank", 9).alias("rank"))


@query("search_captures", f"""WITH {DC}, {CAP_TOK}, {_rank_sql(_q('the and src7'))}
  SELECT id, ts, appName, fullOcrText, round(rank, 9) AS rank FROM ranked JOIN docs_c USING (id) ORDER BY ranked.rank, id LIMIT 50""")
def _(spark, d):
    return search.search_captures(documents(spark, d), "the and src7", 50, stem=False).select(
        "id", "ts", "appName", "fullOcrText", F.round("rank", 9).alias("rank"))


@query("search_summaries", f"""WITH {SM}, {SUM_TOK}, {_rank_sql(_q('the of'))}
  SELECT id, startTs, app, summary, round(rank, 9) AS rank FROM ranked JOIN sums USING (id)
  WHERE endTs >= TIMESTAMP '{DOC_NOW}' - INTERVAL 43200 SECOND AND '["' || app || '"]' LIKE '%src1%' ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    return search.search_summaries(summaries(spark, d), "the of", 20, DOC_NOW, 720, "SRC1", stem=False).select(
        "id", "startTs", F.array_join("appNames", ",").alias("app"), "summary", F.round("rank", 9).alias("rank"))


@query("search_phrase", f"""WITH {DC}, {CAP_TOK}, {_rank_sql([['the', 'of', 'the']])}
  SELECT id, strftime(ts, {FMT}) AS time, frameType AS type, appName AS app, windowTitle AS "window", substr(fullOcrText, 1, 120) AS text_preview,
    round(rank, 9) AS rank FROM ranked JOIN docs_c USING (id) ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    return search.search_phrase(documents(spark, d), "the of the", stem=False).withColumn("rank", F.round("rank", 9))


@query("search_phrase_summaries", f"""WITH {SM}, {SUM_TOK}, {_rank_sql([['and', 'the']])}
  SELECT id, strftime(startTs, {FMT}) AS start, '["' || app || '"]' AS apps, substr(summary, 1, 150) AS summary_preview, round(rank, 9) AS rank
  FROM ranked JOIN sums USING (id) ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    return search.search_phrase_summaries(summaries(spark, d), "and the", stem=False).withColumn("rank", F.round("rank", 9))


_SAVED: dict[tuple, str] = {}


def _saved_index(spark, d, kind: str):
    """An index saved by term buckets, once for each application and folder."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _SAVED:
        path = scratch(spark, f"index-{kind}")
        rows, fields = {
            "captures": (documents(spark, d), {c: c for c in search.CAPTURE_FIELDS}),
            "summaries": (summaries(spark, d), dict(zip(["summary", "keyTopics", "appNames"], search.summary_fields()))),
        }[kind.split("-")[0]]
        search.TextIndex.build(rows, fields, kind.endswith("-stemmed"), keep=False).save(path, 16, 2, rows_per_block=64)
        _SAVED[key] = path
    return search.TextIndex.load(spark, _SAVED[key], kind.endswith("-stemmed"), 16)


@query("build_index", f"WITH {DC}, {CAP_TOK} SELECT term, count(DISTINCT id) AS rows, count(*) AS occurrences FROM tk GROUP BY term")
def _(spark, d):
    """Tokenises, packs and saves; the searches below read what this has saved."""
    rows = _saved_index(spark, d, "captures").postings
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.sum("tf").alias("occurrences"))


@query("build_index_stemmed", f"WITH {DC}, {CAP_TOK} SELECT id, len FROM ln")
def _(spark, d):
    return _saved_index(spark, d, "captures-stemmed").lengths.select("id", "len")


@query("top_blocks", f"""WITH {DC}, {CAP_TOK}, {_rank_sql(_q('the of and'))}
  SELECT id, round(rank, 9) AS rank FROM ranked ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    """Frequent words: blocks that cannot reach the best twenty are left out."""
    return _saved_index(spark, d, "captures").top(_q("the of and"), 20).select("id", F.round("rank", 9).alias("rank"))


@query("search_captures_indexed", f"""WITH {DC}, {CAP_TOK}, {_rank_sql(_q('the and src3'))}
  SELECT id, ts, appName, fullOcrText, round(rank, 9) AS rank FROM ranked JOIN docs_c USING (id) ORDER BY ranked.rank, id LIMIT 50""")
def _(spark, d):
    return search.search_captures(documents(spark, d), "the and src3", 50, index=_saved_index(spark, d, "captures")).select(
        "id", "ts", "appName", "fullOcrText", F.round("rank", 9).alias("rank"))


# No other token has the stem of this word, so the twin needs no stemmer.
@query("search_captures_stemmed", f"""WITH {DC}, {CAP_TOK}, {_rank_sql(_q('src5'))}
  SELECT id, round(rank, 9) AS rank FROM ranked ORDER BY ranked.rank, id LIMIT 50""")
def _(spark, d):
    return search.search_captures(documents(spark, d), "src5", 50, index=_saved_index(spark, d, "captures-stemmed")).select("id", F.round("rank", 9).alias("rank"))


# The words of the documents that have the stems of two query words; the stemmer changes most of them.
_STEMS = {"erli": ["erly", "erlyed", "erlying"], "erh": ["erhe", "erheing", "erhely", "erhelyed", "erhelying"]}
_STEMMED = "stemmed AS (SELECT id, field, pos, CASE " + " ".join(
    f"WHEN term IN ({', '.join(repr(w) for w in words)}) THEN '{s}'" for s, words in _STEMS.items()) + " ELSE term END AS term FROM tk)"


@query("search_words_stemmed", f"""WITH {DC}, {CAP_TOK}, {_STEMMED}, {_rank_sql([["erli"], ["erh"]]).replace("FROM tk t0", "FROM stemmed t0")}
  SELECT id, round(rank, 9) AS rank FROM ranked ORDER BY ranked.rank, id LIMIT 50""")
def _(spark, d):
    return search.search_captures(documents(spark, d), "Erlying erhely", 50, index=_saved_index(spark, d, "captures-stemmed")).select("id", F.round("rank", 9).alias("rank"))


@query("search_summaries_indexed", f"""WITH {SM}, {SUM_TOK}, {_rank_sql(_q('the of'))}
  SELECT id, startTs, app, summary, round(rank, 9) AS rank FROM ranked JOIN sums USING (id)
  WHERE endTs >= TIMESTAMP '{DOC_NOW}' - INTERVAL 43200 SECOND AND '["' || app || '"]' LIKE '%src1%' ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    found = search.search_summaries(summaries(spark, d), "the of", 20, DOC_NOW, 720, "SRC1", index=_saved_index(spark, d, "summaries"))
    return found.select("id", "startTs", F.array_join("appNames", ",").alias("app"), "summary", F.round("rank", 9).alias("rank"))


@query("search_phrase_indexed", f"""WITH {DC}, {CAP_TOK}, {_rank_sql([['the', 'of', 'the']])}
  SELECT id, round(rank, 9) AS rank FROM ranked ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    return search.search_phrase(documents(spark, d), "the of the", index=_saved_index(spark, d, "captures")).select("id", F.round("rank", 9).alias("rank"))


@query("api_search_indexed", f"""WITH {SM}, {SUM_TOK}, {_rank_sql(_q('to and'))}
  SELECT strftime(startTs, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, app AS app_name, summary AS relevant_text
  FROM ranked JOIN sums USING (id) WHERE endTs >= TIMESTAMP '{DOC_NOW}' - INTERVAL 86400 SECOND ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    return api.search(summaries(spark, d), " to and ", DOC_NOW, index=_saved_index(spark, d, "summaries")).select("timestamp", "app_name", "relevant_text")


_CHANGED = DC.replace("FROM documents)", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 1 THEN lang || ' the changed text ' || source ELSE text END AS text) FROM documents) WHERE doc_id % 7 <> 3)")


@query("index_maintenance", f"""WITH {_CHANGED}, {CAP_TOK}, {_rank_sql(_q('the changed'))} SELECT id, round(rank, 9) AS rank FROM ranked""")
def _(spark, d):
    docs, fields = documents(spark, d), {c: c for c in search.CAPTURE_FIELDS}
    index = _saved_index(spark, d, "captures").without(docs.filter("id % 7 = 3").select("id"))  # delete
    # One row in five gets a new text: update = delete + insert.
    new = docs.filter("id % 5 = 1 AND id % 7 <> 3").withColumn("fullOcrText", F.concat("windowTitle", F.lit(" the changed text "), "appName"))
    index = index.updated(search.TextIndex.build(new, fields, False, keep=False))
    return index.rank(_q("the changed")).select("id", F.round("rank", 9).alias("rank"))


@query("index_maintenance_saved", f"""WITH {_CHANGED}, {CAP_TOK}, {_rank_sql(_q('the changed'))} SELECT id, round(rank, 9) AS rank FROM ranked""")
def _(spark, d):
    """The same on the files of a saved index: ids that are gone and a segment for the new rows are added."""
    docs, fields, path = documents(spark, d), {c: c for c in search.CAPTURE_FIELDS}, scratch(spark, "index-kept")
    search.TextIndex.build(docs, fields, False, keep=False).save(path, 16, 2, rows_per_block=64)
    search.TextIndex.delete(spark, path, docs.filter("id % 7 = 3 OR id % 5 = 1").select("id"))
    new = docs.filter("id % 5 = 1 AND id % 7 <> 3").withColumn("fullOcrText", F.concat("windowTitle", F.lit(" the changed text "), "appName"))
    search.TextIndex.build(new, fields, False, keep=False).save(path, 16, 2, "append")
    return search.TextIndex.load(spark, path, False, 16).rank(_q("the changed")).select("id", F.round("rank", 9).alias("rank"))


def _many_sql(queries_: str, limit: int) -> str:
    """CTE ``many(query_id, id, rank, position)`` for queries whose words may hold several tokens."""
    return f"""qw AS (SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) AS phrase FROM (
      SELECT query_id, string_split(trim(regexp_replace(text, '{WS}', ' ', 'g')), ' ') AS w FROM {queries_})),
  qp AS (SELECT query_id, phrase, {TOK.format("replace(word, chr(34), '')")} AS toks FROM qw),
  okq AS (SELECT query_id, count(*) AS np FROM qp GROUP BY query_id HAVING min(len(toks)) > 0),
  ph AS (SELECT DISTINCT toks FROM qp WHERE len(toks) > 0),
  pt AS (SELECT toks, unnest(toks) AS term, generate_subscripts(toks, 1) AS o FROM ph),
  occ AS (SELECT toks, id, field, pos - o AS s FROM pt JOIN tk USING (term) GROUP BY toks, id, field, pos - o HAVING count(*) = len(toks)),
  ptf AS (SELECT toks, id, count(*) AS tf FROM occ GROUP BY toks, id),
  pdf AS (SELECT toks, count(*) AS df FROM ptf GROUP BY toks),
  idf AS (SELECT toks, mean, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM pdf, corpus),
  hit AS (SELECT query_id, id, count(*) AS n, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS rank
    FROM qp JOIN okq USING (query_id) JOIN ptf USING (toks) JOIN idf USING (toks) JOIN ln USING (id) GROUP BY query_id, id HAVING count(*) = any_value(np)),
  many AS (SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), id) AS position FROM hit
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), id) <= {limit})"""


BQ = "bq AS (SELECT item_id AS query_id, text FROM benchmark)"


def _benchmark(spark, d):
    return views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("search_many", f"WITH {DC}, {CAP_TOK}, {BQ}, {_many_sql('bq', 50)} SELECT query_id, id, round(rank, 6) AS rank, position FROM many")
def _(spark, d):
    return search.search_many(_index(spark, d), _benchmark(spark, d), 50).withColumn("rank", F.round("rank", 6))


# -- API queries --------------------------------------------------------------------------------------

ISO = "'%Y-%m-%dT%H:%M:%SZ'"


@query("api_search", f"""WITH {SM}, {SUM_TOK}, {_rank_sql(_q('to and'))}
  SELECT strftime(startTs, {ISO}) AS timestamp, app AS app_name, CAST(NULL AS VARCHAR) AS window_title, summary AS relevant_text,
    'FTS match — topics: ' || lang || ', ' || app AS relevance_explanation, 'summary' AS source
  FROM ranked JOIN sums USING (id) WHERE endTs >= TIMESTAMP '{DOC_NOW}' - INTERVAL 86400 SECOND ORDER BY ranked.rank, id LIMIT 20""")
def _(spark, d):
    return api.search(summaries(spark, d), " to and ", DOC_NOW, stem=False)


@query("api_list_summaries", f"""WITH {SM} SELECT strftime(startTs, {ISO}) AS start_timestamp, strftime(endTs, {ISO}) AS end_timestamp, app AS app_names,
  summary, lang || ',' || app AS key_topics FROM sums WHERE endTs >= TIMESTAMP '{DOC_NOW}' - INTERVAL 5000 MINUTE AND startTs <= TIMESTAMP '{DOC_NOW}'
  ORDER BY startTs DESC, id DESC LIMIT 1000""")
def _(spark, d):
    return api.list_summaries(summaries(spark, d), DOC_NOW, 5000, 1000).withColumns(
        {c: _list(c) for c in ("app_names", "key_topics")})


@query("api_activity_captures", f"""WITH {EV} SELECT strftime(ts, {ISO}) AS timestamp, appName AS app_name, windowTitle AS window_title, fullOcrText AS text,
  'capture' AS kind, frameType AS frame_type, changePercentage AS change_percentage FROM events_c
  WHERE ts BETWEEN TIMESTAMP '2024-01-15 12:00:00.25' - INTERVAL 299970 SECOND AND TIMESTAMP '2024-01-15 12:00:00.25' + INTERVAL 299970 SECOND
  ORDER BY ts DESC, id DESC LIMIT 9999""")
def _(spark, d):
    return api.activity(events(spark, d), summaries(spark, d), NOW, "2024-01-15T12:00:00.25Z", 9999, "captures", 9999)


@query("api_activity_summaries", f"""WITH {SM} SELECT strftime(startTs, {ISO}) AS timestamp, app AS app_name, CAST(NULL AS VARCHAR) AS window_title, summary AS text,
  'summary' AS kind, CAST(NULL AS VARCHAR) AS frame_type, CAST(NULL AS DOUBLE) AS change_percentage FROM sums
  WHERE endTs >= TIMESTAMP '{DOC_NOW}' - INTERVAL 150 SECOND AND startTs <= TIMESTAMP '{DOC_NOW}' + INTERVAL 150 SECOND ORDER BY startTs DESC, id DESC LIMIT 100""")
def _(spark, d):
    return api.activity(events(spark, d), summaries(spark, d), DOC_NOW, "no time", kind="summaries")


@query("iso_time", f"""SELECT event_id AS id, strftime(ts, {ISO}) AS iso, date_trunc('second', ts) AS parsed, ts AS parsed_fraction,
  epoch_us(ts) / 1e6 AS epoch FROM events""")
def _(spark, d):
    e = events(spark, d).select("id", "ts", clock.iso_format("ts").alias("iso"))
    fraction = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select("id", "iso", clock.iso_parse("iso").alias("parsed"), clock.iso_parse(fraction).alias("parsed_fraction"),
                    clock.epoch_seconds("ts").alias("epoch"))


# -- retrieval -------------------------------------------------------------------------------------------


@query("render_template", "SELECT event_id AS id, 'User ' || user_id || ' did {' || event_type || '} of ' || props || ' {other}' AS line FROM events")
def _(spark, d):
    return events(spark, d).select("id", text.render_template("User {u} did {{a}} of {p} {other}", {
        "u": F.col("device").cast("string"), "a": "appName", "p": "fullOcrText"}).alias("line"))


@query("duration_text", """SELECT event_id AS id, CASE WHEN value < 60 THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) || 's'
  ELSE CAST(CAST(trunc(value / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(trunc(value) AS BIGINT) % 60 AS VARCHAR) || 's' END AS duration FROM events""")
def _(spark, d):
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), clock.duration_text("value").alias("duration"))


@query("range_label", """SELECT event_id AS id, CASE WHEN value < 60 THEN 'Last ' || CAST(trunc(value) AS BIGINT) || ' min'
  ELSE 'Last ' || CAST(trunc(value) AS BIGINT) // 60 || 'h ' || CAST(trunc(value) AS BIGINT) % 60 || 'm' END AS label FROM events""")
def _(spark, d):
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), clock.range_label("value").alias("label"))


@query("relative_time", f"""WITH s AS (SELECT event_id AS id, ts > TIMESTAMP '{NOW}' AS ahead, abs(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) // 1000000 AS s FROM events),
  t AS (SELECT *, CASE WHEN s >= 2592000 THEN s // 2592000 || ' mo' WHEN s >= 604800 THEN s // 604800 || ' wk' WHEN s >= 86400 THEN s // 86400 || ' day'
    WHEN s >= 3600 THEN s // 3600 || ' hr' WHEN s >= 60 THEN s // 60 || ' min' ELSE s || ' sec' END AS x FROM s)
  SELECT id, CASE WHEN ahead THEN 'in ' || x ELSE x || ' ago' END AS distance FROM t""")
def _(spark, d):
    return events(spark, d).select("id", clock.relative_time("ts", NOW).alias("distance"))


_FENCE = "'```json' || chr(10) || props || chr(10) || '```  '"


@query("strip_code_fences", "SELECT event_id AS id, props AS bare FROM events")
def _(spark, d):
    fenced = F.concat(F.lit(" ```json\n"), "fullOcrText", F.lit("\n```  "))
    value = F.when(F.col("id") % 2 == 0, fenced).otherwise(F.concat("fullOcrText", F.lit("\n ")))
    return events(spark, d).select("id", text.strip_code_fences(value).alias("bare"))


@query("parse_summary", """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN 'plain ' || text ELSE text END AS summary,
  CASE doc_id % 4 WHEN 0 THEN lang || ',' || source ELSE '' END AS topics FROM documents""")
def _(spark, d):
    doc = documents(spark, d)
    good = F.to_json(F.struct(F.col("fullOcrText").alias("summary"), F.array("windowTitle", "appName").alias("key_topics")))
    # Of four replies one is complete and fenced, one has a mixed topic list, one has no topics, one is not JSON.
    mixed = F.concat(F.expr("substring(to_json(struct(fullOcrText AS summary)), 1, length(to_json(struct(fullOcrText AS summary))) - 1)"),
                     F.lit(',"key_topics":["a",1]}'))
    reply = (F.when(F.col("id") % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
             .when(F.col("id") % 4 == 1, mixed).when(F.col("id") % 4 == 2, F.to_json(F.struct(F.col("fullOcrText").alias("summary"))))
             .otherwise(F.concat(F.lit("plain "), "fullOcrText")))
    out = doc.select("id", replies.parse_summary(reply).alias("p"))
    return out.select("id", "p.summary", F.array_join("p.keyTopics", ",").alias("topics"))


@query("parse_relevant_ids", """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '' ELSE CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) END AS ids FROM events""")
def _(spark, d):
    e = views.table(spark, d, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.lit('[{"id": 1}, 2]')).otherwise(F.concat(
        F.lit('[{"id": '), "event_id", F.lit(', "reason": "x"}, {"id": '), "user_id", F.lit('.75}, {"id": "7"}, {"id": -5}, {"id": '),
        "event_id", F.lit("}]")))
    ids = replies.parse_relevant_ids(reply, F.array("event_id", "user_id"))
    return e.select(F.col("event_id").alias("id"), _as_text(ids).alias("ids"))


def _as_text(ids):
    return F.array_join(ids.cast("array<string>"), ",")


@query("parse_citations", """SELECT doc_id AS id, CAST(0 AS BIGINT) AS n, '2024-01-01T14:00:00Z' AS timestamp, source AS app_name, CAST(NULL AS VARCHAR) AS window_title,
    text AS relevant_text, lang AS relevance_explanation, 'capture' AS source FROM documents
  UNION ALL SELECT doc_id, 1, 't', 'Unknown', lang, text, source, 'summary' FROM documents""")
def _(spark, d):
    doc = documents(spark, d)
    a = F.to_json(F.struct(F.col("appName").alias("app_name"), F.col("fullOcrText").alias("relevant_text"),
                           F.col("windowTitle").alias("relevance_explanation"), F.lit(3).alias("timestamp")))
    b = F.to_json(F.struct(F.lit("t").alias("timestamp"), F.lit("summary").alias("source"), F.col("windowTitle").alias("window_title"),
                           F.col("fullOcrText").alias("relevant_text"), F.col("appName").alias("relevance_explanation")))
    reply = F.concat(F.lit("["), a, F.lit(', {"relevant_text": "x"}, '), b, F.lit("]"))
    found = replies.parse_citations(reply, clock.iso_format(clock.instant(DOC_NOW)))
    return doc.select("id", F.posexplode(found).alias("n", "c")).select("id", "n", "c.*")


_RECENT = f"recent AS (SELECT id, row_number() OVER (ORDER BY startTs DESC, id DESC) AS position FROM sums WHERE endTs >= TIMESTAMP '{DOC_START}' AND startTs <= TIMESTAMP '{DOC_END}' QUALIFY position <= 15)"
_CANDS = f"""{SM}, {SUM_TOK}, {BQ}, {_many_sql('bq', 15)}, {_RECENT},
  allc AS (SELECT query_id AS prompt_id, id, 0 AS priority, position FROM many UNION ALL SELECT query_id, recent.id, 1, recent.position FROM bq, recent),
  cands AS (SELECT * FROM allc QUALIFY row_number() OVER (PARTITION BY prompt_id, id ORDER BY priority) = 1)"""


def _prompts(spark, d):
    return views.table(spark, d, "benchmark").select(F.col("item_id").alias("prompt_id"), "text")


def _candidates(spark, d):
    return retrieve.candidate_summaries(_prompts(spark, d), summaries(spark, d), DOC_START, DOC_END, 30, _saved_index(spark, d, "summaries"))


@query("candidate_summaries", f"WITH {_CANDS} SELECT prompt_id, id, CAST(priority AS BIGINT) AS priority, position FROM cands")
def _(spark, d):
    return _candidates(spark, d)


@query("summary_listing_text", f"""WITH {_CANDS} SELECT prompt_id, string_agg('[' || id || ']: ' || strftime(startTs, '%H:%M:%S') || ' - ' || strftime(endTs, '%H:%M:%S')
  || chr(10) || 'Apps: ' || app || chr(10) || 'Topics: ' || lang || ', ' || app || chr(10) || 'Summary: ' || summary, chr(10) || chr(10) ORDER BY priority, position) AS listing,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY priority, position) AS ids FROM cands JOIN sums USING (id) GROUP BY prompt_id""")
def _(spark, d):
    return retrieve.summary_listing_text(_candidates(spark, d), summaries(spark, d)).withColumn("ids", _list("ids"))


@query("unsummarized_candidates", f"""WITH {DC}, {CAP_TOK}, {BQ}, {_many_sql('bq', 25)},
  recent AS (SELECT id, row_number() OVER (ORDER BY ts DESC, id DESC) AS position FROM docs_c WHERE NOT isSummarized AND ts BETWEEN TIMESTAMP '{DOC_START}' AND TIMESTAMP '{DOC_END}' QUALIFY position <= 25),
  allc AS (SELECT query_id AS prompt_id, many.id, 0 AS priority, position FROM many JOIN docs_c ON docs_c.id = many.id AND NOT isSummarized
    UNION ALL SELECT query_id, recent.id, 1, recent.position FROM bq, recent)
  SELECT prompt_id, id, CAST(priority AS BIGINT) AS priority, position FROM allc QUALIFY row_number() OVER (PARTITION BY prompt_id, id ORDER BY priority) = 1""")
def _(spark, d):
    return retrieve.unsummarized_candidates(_prompts(spark, d), documents(spark, d), DOC_START, DOC_END, 50, _saved_index(spark, d, "captures"))


def _indexes(spark, d):
    return _saved_index(spark, d, "summaries"), _saved_index(spark, d, "captures")


def _echo(messages, model, max_tokens, system, temperature):
    """Deterministic stand-in for a model: every summary is relevant; the answer is a digest of the prompt."""
    import hashlib
    import json
    import re
    body = messages[0]["content"]
    digest = hashlib.md5(body.encode()).hexdigest()
    if body.startswith("Prompt:") and "\nSummaries:\n" in body:
        ids = re.findall(r"^\[(\d+)\]: \d\d:\d\d:\d\d - ", body, re.M)
        return Completion(json.dumps([{"id": int(i)} for i in ids]), len(body), len(ids))
    if body.startswith("Query:"):
        return Completion(json.dumps([{"relevant_text": digest, "relevance_explanation": "digest"}]), len(body), 1)
    return Completion(f"[^1]: {digest}", len(body), 1)


def _renamed(sql: str) -> str:
    """The same CTEs under other names, for a second search in one statement."""
    import re
    names = "tk|ln(?!\\()|corpus|qw|qp|okq|ph|pt|occ|ptf|pdf|idf|hit|many|recent|allc|cands"
    return re.sub(rf"(?<!\.)\b({names})\b", r"\1_s", sql)


def _filled(template: str, **values: str) -> str:
    """SQL text of a template whose ``{names}`` stand for SQL values."""
    import re
    parts = re.split(r"\{(\w+)\}", template)
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts[::2]]
    return " || ".join(x for pair in zip(quoted, [*(values[n] for n in parts[1::2]), "''"]) for x in pair)


_FOOTNOTES = _filled(Templates().footnotes_user, query="bq.text", captures="rendered.text")
_CITATIONS = _filled(Templates().citations_user, query="bq.text", captures="rendered.text")
_SUMMARY = _filled(
    Templates().summary_user, start_time="strftime(startTs, '%H:%M:%S')", end_time="strftime(endTs, '%H:%M:%S')",
    duration="(CASE WHEN epoch_us(endTs) - epoch_us(startTs) < 60000000 THEN '' ELSE CAST((epoch_us(endTs) - epoch_us(startTs)) // 60000000 AS VARCHAR) || 'm ' END"
             " || CAST((epoch_us(endTs) - epoch_us(startTs)) // 1000000 % 60 AS VARCHAR) || 's')",
    app_name="primaryApp", window_title="'Unknown'", ocr_samples="text")

# Both retrieval paths with the stand-in model, which finds every summary relevant.
_CONTEXT = f"""{DC}, {SM}, {BQ}, {_renamed(_CANDS.replace(SM + ', ', '').replace(BQ + ', ', ''))},
  via AS (SELECT prompt_id, id FROM cands_s WHERE id IN (SELECT id FROM sums)),
  {CAP_TOK}, {_many_sql('bq', 25)},
  recent AS (SELECT id FROM docs_c WHERE NOT isSummarized AND ts BETWEEN TIMESTAMP '{DOC_START}' AND TIMESTAMP '{DOC_END}' ORDER BY ts DESC, id DESC LIMIT 25),
  both_ AS (SELECT prompt_id, id FROM via UNION SELECT query_id, many.id FROM many JOIN docs_c ON docs_c.id = many.id AND NOT isSummarized
    UNION SELECT query_id, recent.id FROM bq, recent),
  picked AS (SELECT both_.prompt_id, docs_c.* FROM both_ JOIN docs_c USING (id) QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY ts DESC, id DESC) <= 50),
  {_sections('picked', 'prompt_id', 10, 5, 3000, 500)},
  counted AS (SELECT prompt_id, count(*) AS captures_examined FROM picked GROUP BY prompt_id),
  searched AS (SELECT prompt_id, count(*) AS summaries_searched FROM cands_s GROUP BY prompt_id),
  answer AS (SELECT bq.query_id AS prompt_id, bq.text, captures_examined, summaries_searched,
      md5({_FOOTNOTES}) AS footnotes, md5({_CITATIONS}) AS quotes
    FROM bq JOIN rendered ON rendered.prompt_id = bq.query_id JOIN counted ON counted.prompt_id = bq.query_id JOIN searched ON searched.prompt_id = bq.query_id)"""


@query("enrich", f"""WITH {_CONTEXT} SELECT prompt_id, text AS originalPrompt,
  text || chr(10) || chr(10) || '---' || chr(10) || '## Context References' || chr(10) || chr(10) || '[^1]: ' || footnotes AS enrichedPrompt,
  summaries_searched, captures_examined, CAST(NULL AS VARCHAR) AS error FROM answer""")
def _(spark, d):
    return retrieve.enrich(_prompts(spark, d), documents(spark, d), summaries(spark, d), DOC_START, DOC_END, _echo, stem=False, indexes=_indexes(spark, d))


@query("query_citations", f"""WITH {_CONTEXT} SELECT prompt_id, text,
  '[{{"timestamp":"2024-01-01T14:00:00Z","app_name":"Unknown","relevant_text":"' || quotes
    || '","relevance_explanation":"digest","source":"capture"}}]' AS citations,
  summaries_searched, captures_examined, CAST(NULL AS VARCHAR) AS error FROM answer""")
def _(spark, d):
    out = retrieve.query_citations(_prompts(spark, d), documents(spark, d), summaries(spark, d), DOC_START, DOC_END, DOC_NOW, _echo, stem=False, indexes=_indexes(spark, d))
    return out.withColumn("citations", F.to_json("citations"))


@query("progressive_summarize", f"""WITH RECURSIVE {CV}, {_hybrid('conv_c', 300, 15)}, {FEATURES}, {_sections('hybrid', 'device, chunkId', 10, 3, 2000, 300)}
  SELECT startTs, endTs, appNames, '' AS keyTopics, captureIds, '[^1]: ' || md5({_SUMMARY}) AS summary
  FROM feat JOIN prime USING (device, chunkId) JOIN rendered USING (device, chunkId)""")
def _(spark, d):
    made, _, _ = summarize.progressive_summarize(conversations(spark, d), "2034-01-01 00:00:00", _echo, ["device"])
    return made.withColumns({c: _list(c) for c in ("appNames", "keyTopics", "captureIds")}).drop("id", "chunkKey")


@query("summarize_pending", f"""WITH RECURSIVE {CV}, {_hybrid('conv_c', 300, 15)}, {FEATURES}, {_sections('hybrid', 'device, chunkId', 10, 3, 2000, 300)}
  SELECT startTs, endTs, appNames, '' AS keyTopics, captureIds, '[^1]: ' || md5({_SUMMARY}) AS summary
  FROM feat JOIN prime USING (device, chunkId) JOIN rendered USING (device, chunkId)""")
def _(spark, d):
    """Three rounds over stored tables; half of the devices come between the first and the second, the third finds nothing to do."""
    rows, extra = conversations(spark, d), T.StructType([T.StructField("device", T.StringType())])
    rows = rows.withColumn("device", F.col("device").cast("string")).drop("isSummarized")
    c, s, u, pending, ledger = (scratch(spark, n) for n in ("captures", "summaries", "usage", "pending", "ledger"))
    for part in ("pmod(hash(device), 2) = 0", "pmod(hash(device), 2) = 1", "false"):
        tables.append_captures(rows.filter(part), c, pending)
        chunk_stream.summarize_pending(spark, c, s, u, "2034-01-01 00:00:00", _echo, ["device"], extra=extra, pending=pending, ledger=ledger)
    return tables.read_summaries(spark, s).withColumns({n: _list(n) for n in ("appNames", "keyTopics", "captureIds")}).drop("id")


@query("usage_from_responses", f"""WITH RECURSIVE {CV}, {_hybrid('conv_c', 300, 15)}, {FEATURES}, {_sections('hybrid', 'device, chunkId', 10, 3, 2000, 300)}
  SELECT captures, startTs, 'summarizer' AS caller, 'default' AS model, length({_SUMMARY}) AS "inputTokens", CAST(1 AS BIGINT) AS "outputTokens"
  FROM (SELECT *, len(string_split("captureIds", ',')) AS captures FROM feat) JOIN prime USING (device, chunkId) JOIN rendered USING (device, chunkId)""")
def _(spark, d):
    made, used, _ = summarize.progressive_summarize(conversations(spark, d), "2034-01-01 00:00:00", _echo, ["device"])
    # Usage rows and summaries come from one reply each: both ids are made from the chunk's key.
    key = F.xxhash64("chunkKey", F.lit("summarizer")).bitwiseAND(F.lit(2**63 - 1))
    made = made.select(key.alias("id"), "startTs", F.size("captureIds").alias("captures"))
    return used.join(made, "id").select("captures", "startTs", "caller", "model", "inputTokens", "outputTokens")


# -- streams, drained into a table ---------------------------------------------------------------------------


def _drained(spark, parts, transform=lambda s: s, **options):
    """The rows that ``transform`` gives for a stream that gets ``parts`` one after the other; each is drained before the next comes."""
    source, checkpoint, path = scratch(spark, "source"), scratch(spark, "stream"), scratch(spark, "drained")
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = transform(cap_stream.stream_captures(spark, source, part.schema, **options))
        (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def _far(rows):
    """A row so late that the watermark passes all others; its own key stays waiting."""
    none = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields}
    far = {"id": F.lit(-1), "ts": F.lit("2099-01-01 00:00:00").cast("timestamp"), "device": F.lit(-1)}
    one = rows.sparkSession.range(1)
    return one.select(*[far.get(c, none[c]).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


@query("stream_captures", "SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS device, role AS appName, text AS fullText FROM conversations")
def _(spark, d):
    return _drained(spark, [views.observations_of_conversations(spark, d)], max_files=1).select("id", "device", "appName", "fullText")


@query("dedup_consecutive_stream", f"""WITH {EV}, p AS (SELECT id, device, textHash, lag(textHash) OVER (PARTITION BY device ORDER BY ts, id) AS h FROM events_c)
  SELECT id, device FROM p WHERE h IS NULL OR h <> textHash""")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "textHash")
    return _drained(spark, [rows], cap_stream.dedup_consecutive_stream).select("id", "device")


@query("dedup_consecutive_stream_unordered", f"""WITH {EV}, p AS (SELECT id, device, appName, textHash, lag(textHash) OVER (PARTITION BY device ORDER BY ts, id) AS h FROM events_c)
  SELECT id, device, appName FROM p WHERE h IS NULL OR h <> textHash""")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "appName", "textHash")
    # The later half arrives first; both wait for the watermark.
    parts = [rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), _far(rows)]
    return _drained(spark, parts, lambda s: cap_stream.dedup_consecutive_stream(s, delay="4000 days", bucket="60 days")).select("id", "device", "appName")


@query("dedup_within", f"WITH {EV} SELECT DISTINCT device, textHash FROM events_c")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "textHash")
    return _drained(spark, [rows], lambda s: cap_stream.dedup_within(s, "4000 days"), max_files=1).select("device", "textHash")


@query("chunk_by_time_stream", f"WITH RECURSIVE {EV}, {_windows('events_c', 86400)} SELECT id, device, windowStart, false AS late FROM windowed")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "appName")
    stream = lambda s: chunk_stream.chunk_by_time_stream(s, window=86_400, delay="4000 days", bucket="7 days")
    return _drained(spark, [rows, _far(rows)], stream).select("id", "device", "windowStart", "late")


# Every fifth row comes after all others and two weeks behind; those whose bucket of a week the watermark has passed are late.
_LATE = "(id % 5 = 0 AND epoch_ms(ts) // 604800000 < (SELECT epoch_ms(max(ts)) - 14 * 86400000 FROM events_c WHERE id % 5 <> 0) // 604800000)"


@query("chunk_by_time_stream_late", f"""WITH RECURSIVE {EV}, seen AS (SELECT * FROM events_c WHERE NOT {_LATE}), {_windows('seen', 86400)}
  SELECT id, device, windowStart, false AS late FROM windowed UNION ALL SELECT id, device, CAST(NULL AS TIMESTAMP), true FROM events_c WHERE {_LATE}""")
def _(spark, d):
    rows = events(spark, d).select("id", "ts", "device", "appName")
    parts = [rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0"), _far(rows)]
    stream = lambda s: chunk_stream.chunk_by_time_stream(s, window=86_400, delay="14 days", bucket="7 days")
    return _drained(spark, parts, stream).select("id", "device", "windowStart", "late")


# -- frames and regions -------------------------------------------------------------------------------------


@query("array_tile_diff", """WITH p AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
  SELECT vec_id AS id, label AS stream, round(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE)))), 6) AS total FROM p""")
def _(spark, d):
    return frames.array_tile_diff(views.tiles_of_embeddings(spark, d), "values", ["stream"]).select(
        "id", F.col("stream").cast("long").alias("stream"), F.round("total", 6).alias("total"))


def _pixel(x):
    return (F.floor((x + F.lit(1.0)) * F.lit(127.0)).cast("int"))


def _frames(spark, d):
    """Vectors as 8 x 8 grey BGRA frames; the label is the stream."""
    e = views.table(spark, d, "embeddings")
    hexes = F.array_join(F.transform("embedding", lambda x: F.concat(F.repeat(F.lpad(F.hex(_pixel(x.cast("double"))), 2, "0"), F.lit(3)), F.lit("FF"))), "")
    return e.select(F.col("label").cast("string").alias("stream"), F.timestamp_seconds("vec_id").alias("ts"), F.col("vec_id").alias("id"),
                    F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(hexes).alias("pixels"))


_TILES = """px AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS stream, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1.0) * 127.0) AS BIGINT)) AS a FROM embeddings),
  pp AS (SELECT id, stream, a, lag(a) OVER (PARTITION BY stream ORDER BY id) AS b, lag(id) OVER (PARTITION BY stream ORDER BY id) AS previousId FROM px),
  td AS (SELECT id, stream, previousId, CASE WHEN b IS NOT NULL THEN CAST(3 * list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS BIGINT) END AS total FROM pp)"""


_TILES2 = """px AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS stream, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1.0) * 127.0) AS BIGINT)) AS a FROM embeddings),
  pp AS (SELECT id, stream, a, lag(a) OVER (PARTITION BY stream ORDER BY id) AS b, lag(id) OVER (PARTITION BY stream ORDER BY id) AS previousId FROM px),
  td AS (SELECT id, stream, previousId, r AS "row", c AS col, 3 * (abs(a[i] - b[i]) + abs(a[i + 1] - b[i + 1]) + abs(a[i + 8] - b[i + 8]) + abs(a[i + 9] - b[i + 9])) AS total
    FROM (SELECT *, r * 16 + c * 2 + 1 AS i FROM pp, range(4) x(r), range(4) y(c))),
  t2 AS (SELECT *, coalesce(total > 120, true) AS changed FROM td)"""


@query("tile_diff_small_tiles", f"""WITH {_TILES2} SELECT id, stream, previousId, "row", col, total, changed FROM t2""")
def _(spark, d):
    return frames.tile_diff(_frames(spark, d), tile=2).select("id", "stream", "previousId", "row", "col", "total", "changed")


@query("tile_diff", f"WITH {_TILES} SELECT id, stream, previousId, total, coalesce(total > 1920, true) AS changed FROM td")
def _(spark, d):
    return frames.tile_diff(_frames(spark, d)).select("id", "stream", "previousId", "total", "changed")


@query("change_fraction", f"""WITH {_TILES2} SELECT stream, id, count(*) AS tiles, count(*) FILTER (changed) AS changedTiles,
  count(*) FILTER (changed) / count(*) AS changedFraction, count(*) FILTER (changed) / count(*) >= 0.5 AS significant FROM t2 GROUP BY stream, id""")
def _(spark, d):
    return frames.change_fraction(frames.tile_diff(_frames(spark, d), tile=2))


@query("merge_changed_tiles", f"""WITH RECURSIVE {_TILES2}, cells AS (SELECT id, stream, "row" AS r, col AS c FROM t2 WHERE changed),
  reach AS (SELECT id, r, c, r AS r2, c AS c2 FROM cells
    UNION SELECT q.id, q.r, q.c, n.r, n.c FROM reach q JOIN cells n ON n.id = q.id AND abs(n.r - q.r2) + abs(n.c - q.c2) = 1),
  comp AS (SELECT id, r, c, min(r2 * 4 + c2) AS k FROM reach GROUP BY id, r, c),
  rect AS (SELECT id, k, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM comp GROUP BY id, k)
  SELECT stream, id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS region, c0 * 2 AS x, r0 * 2 AS y, (c1 - c0 + 1) * 2 AS width, (r1 - r0 + 1) * 2 AS height
  FROM rect JOIN px USING (id)""")
def _(spark, d):
    return frames.merge_changed_tiles(frames.tile_diff(_frames(spark, d), tile=2), tile=2, padding=0)


@query("reading_order_text", """WITH RECURSIVE r AS (SELECT vec_id AS f, i, abs(CAST(embedding[i] AS DOUBLE)) AS y, CAST(embedding[1 + i % 64] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)),
  l AS (SELECT f, max(y) AS y0 FROM r GROUP BY f UNION ALL SELECT l.f, max(r.y) FROM l JOIN r ON r.f = l.f AND l.y0 - r.y > 0.02 GROUP BY l.f),
  a AS (SELECT r.*, l.y0 FROM r ASOF JOIN l ON r.f = l.f AND r.y <= l.y0)
  SELECT f AS frame_id, string_agg(CAST(i AS VARCHAR), chr(10) ORDER BY y0 DESC, x, i) AS text FROM a GROUP BY f""")
def _(spark, d):
    e = views.table(spark, d, "embeddings")
    r = e.select(F.col("vec_id").alias("frame_id"), "embedding", F.posexplode("embedding").alias("p", "v")).select(
        "frame_id", (F.col("p") + 1).cast("long").alias("region_id"), F.abs(F.col("v").cast("double")).alias("y"),
        F.expr("cast(embedding[(p + 1) % 64] as double)").alias("x"), (F.col("p") + 1).cast("string").alias("text"))
    return frames.reading_order_text(r)


@query("crop_to_full_coords", """SELECT event_id AS id, round((user_id + value / 500 * 200) / 1920, 9) AS x, round((event_id % 700 + 0.25 * 100) / 1080, 9) AS y,
  round(0.5 * 200 / 1920, 9) AS width, round(0.1 * 100 / 1080, 9) AS height FROM events""")
def _(spark, d):
    e = views.table(spark, d, "events")
    r = e.select(
        F.col("event_id").alias("id"), F.struct((F.col("value") / 500).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("width"), F.lit(0.1).alias("height")).alias("bounds"),
        F.struct(F.col("user_id").alias("x"), (F.col("event_id") % 700).alias("y"), F.lit(200).alias("width"), F.lit(100).alias("height")).alias("crop"),
        F.lit(1920).alias("full_width"), F.lit(1080).alias("full_height"))
    return frames.crop_to_full_coords(r).select("id", *[F.round(f"bounds.{c}", 9).alias(c) for c in ("x", "y", "width", "height")])


@query("regions_fallback", """SELECT d.doc_id AS frame_id, coalesce(n, 0) AS regions, CASE WHEN n IS NULL THEN 'none' WHEN n > 4 THEN 'full' ELSE 'regions' END AS mode
  FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id""")
def _(spark, d):
    regions = views.table(spark, d, "conversations").select(F.col("conv_id").alias("frame_id"))
    return frames.regions_fallback(documents(spark, d).select(F.col("id").alias("frame_id")), regions, 4)


# -- the pipeline's operators, where their subpackage is there ------------------------------------


def _present(name: str) -> bool:
    try:
        return importlib.util.find_spec(name) is not None
    except ModuleNotFoundError:
        return False


if _present("chronoscribe.llm.queries"):
    from chronoscribe.llm import queries as _llm

    for _name, _fn in _llm.QUERIES.items():
        query(_name, _llm.SQL.get(_name))(_fn)


# -- contract ----------------------------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: hybrid chunks per device with their features."""
    return _QUERIES["chunk_features"](spark, SMALL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
