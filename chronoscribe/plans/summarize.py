"""Captures to chunk prompts to summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.functions.clock import clock_text, duration_text, elapsed_seconds, instant, seconds_before
from chronoscribe.functions.replies import parse_summary
from chronoscribe.functions.text import render_template
from chronoscribe.operators.render import joined_sections, with_sections
from chronoscribe.operators.runs import Runs
from chronoscribe.operators.scan import unsummarized_older_than
from chronoscribe.operators.sequence import chunk_feature_columns, hybrid_runs
from chronoscribe.params import Params
from chronoscribe.plans.complete import Complete, ai_map, usage_from_responses
from chronoscribe.plans.prompts import Templates


def summary_prompts(captures: DataFrame, keys: list[str] = (), params: Params = Params(),
                    templates: Templates = Templates(), tz: str = "UTC", **size) -> DataFrame:
    """One row per chunk: features, sampled screen text and the prompt."""
    keys = list(keys)
    # Texts are shortened to what a prompt can show before anything moves.
    shown = max(params.summary_keyframe_chars, params.summary_delta_chars) + 1
    lean = captures.select(*dict.fromkeys([*keys, "id", "ts", "appName", "windowTitle", "frameType", "changePercentage"]),
                           F.substring("ocrText", 1, shown).alias("ocrText"))
    runs = Runs(lean, keys, needs=["appName"], **size)
    chunked = hybrid_runs(runs, params.chunk_seconds, params.min_chunk_seconds).frame()
    # A chunk is part of a sequence that has just been measured.
    inner = size if runs.cut else {**size, "cut": False}
    return prompts_of_chunks(chunked, keys, params, templates, tz, **inner)


def prompts_of_chunks(chunked: DataFrame, keys: list[str] = (), params: Params = Params(),
                      templates: Templates = Templates(), tz: str = "UTC", **size) -> DataFrame:
    """The same for rows that carry a ``chunkId`` already."""
    keys = list(keys)
    parts = with_sections(
        chunked, [*keys, "chunkId"], params.summary_max_keyframes, params.summary_max_deltas,
        params.summary_keyframe_chars, params.summary_delta_chars, tz, **size)
    chunks = parts.groupBy(*keys, "chunkId").agg(*chunk_feature_columns(), joined_sections().alias("samples"))
    return chunks.withColumn("prompt", render_template(templates.summary_user, {
        "start_time": clock_text("startTs", tz), "end_time": clock_text("endTs", tz),
        "duration": duration_text(elapsed_seconds("startTs", "endTs")), "app_name": F.col("primaryApp"),
        "window_title": F.coalesce("primaryWindowTitle", F.lit("Unknown")), "ocr_samples": F.col("samples")}))


def chunk_key(ids: str = "captureIds"):
    """Deterministic key of a chunk: a repeated run gives the same summary row again."""
    return F.sha2(F.to_json(ids), 256)


def summaries_from_replies(replies: DataFrame) -> DataFrame:
    """Summary rows of the chunks that got a reply. The id is taken from the chunk key."""
    ok = replies.filter(F.col("error").isNull()).withColumn("__p", parse_summary("reply"))
    return ok.select(
        F.xxhash64(chunk_key()).bitwiseAND(F.lit(2**63 - 1)).alias("id"), chunk_key().alias("chunkKey"),
        "startTs", "endTs", "appNames", F.col("__p.summary").alias("summary"),
        F.col("__p.keyTopics").alias("keyTopics"), "captureIds")


def progressive_summarize(captures: DataFrame, now, complete: Complete, keys: list[str] = (),
                          params: Params = Params(), templates: Templates = Templates(), model: str = "default",
                          max_tokens: int = 1024, tz: str = "UTC", ledger: str | None = None, **size) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, token usage and failed chunks of the captures that wait and are old enough.

    A failed chunk stays waiting because no summary covers its captures. The whole backlog is taken
    unless ``params.summary_batch_limit`` is set."""
    if params.summary_batch_limit is None:
        waiting = captures.filter((~F.col("isSummarized")) & (F.col("ts") <= seconds_before(now, params.minimum_age)))
    else:
        waiting = unsummarized_older_than(captures, now, params.minimum_age, params.summary_batch_limit)
    prompts = summary_prompts(waiting, keys, params, templates, tz, **size)
    replies = ai_map(prompts, "prompt", complete, model, max_tokens, templates.summary_system, ledger=ledger)
    stamped = replies.withColumn("ts", instant(now)).withColumn(
        "id", F.xxhash64(chunk_key(), F.lit("summarizer")).bitwiseAND(F.lit(2**63 - 1)))
    usage = usage_from_responses(stamped, "summarizer", model)
    return summaries_from_replies(replies), usage, replies.filter(F.col("error").isNotNull())
