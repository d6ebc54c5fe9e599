"""Two-path retrieval for a table of prompts.

Path A: summaries found by search and by time are judged by the model, and the
relevant ones lead to their captures. Path B: captures no summary covers yet,
found by search and by time. Both are merged, the newest ``n`` are rendered, and
a second call writes footnotes or citations.

Everything is keyed by ``prompt_id``; a single prompt is a table of one row.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoscribe.functions.clock import clock_text, instant, iso_format
from chronoscribe.functions.replies import parse_citations, parse_relevant_ids
from chronoscribe.functions.text import render_template
from chronoscribe.operators.joins import merge_candidates, ordered_union_distinct, resolve_captures
from chronoscribe.operators.render import format_hierarchical
from chronoscribe.operators.scan import summaries_overlapping, unsummarized_between
from chronoscribe.operators.search import CAPTURE_FIELDS, TextIndex, search_many, summary_fields
from chronoscribe.params import Params
from chronoscribe.plans.complete import Complete, ai_map
from chronoscribe.plans.prompts import Templates
from chronoscribe.session import durable, stored

# Texts of the output.
NO_CONTEXT = "\n\n_(No relevant context found from recent activity.)_"
CONTEXT_HEADING = "\n\n---\n## Context References\n\n"


def summary_index(summaries: DataFrame, stem: bool = True) -> TextIndex:
    names = ["summary", "keyTopics", "appNames"]
    return TextIndex.build(summaries, dict(zip(names, summary_fields())), stem)


def capture_index(captures: DataFrame, stem: bool = True) -> TextIndex:
    return TextIndex.build(captures, {c: c for c in CAPTURE_FIELDS}, stem)


def _for_each_prompt(prompts: DataFrame, rows: DataFrame) -> DataFrame:
    """The same few ``rows`` (a top-k) beside every prompt: one array from a scalar subquery."""
    packed = rows.agg(F.collect_list(F.struct(*rows.columns))).scalar()
    return prompts.select("prompt_id", F.inline(packed))


def _numbered(rows: DataFrame, ts: str) -> DataFrame:
    """Position in a list of at most some dozens of rows, newest first."""
    w = Window.orderBy(F.col(ts).desc(), F.col("id").desc())
    return rows.select("id", ts).withColumn("position", F.row_number().over(w)).select("id", "position")


def candidate_summaries(prompts: DataFrame, summaries: DataFrame, start, end, limit: int = 30,
                        index: TextIndex | None = None, stem: bool = True) -> DataFrame:
    """``(prompt_id, id, priority, position)``: search hits of all times first, then the latest
    summaries of the range, each at most ``limit / 2``."""
    index = index or summary_index(summaries, stem)
    found = search_many(index, prompts, limit // 2, "prompt_id").select(
        F.col("query_id").alias("prompt_id"), "id", "position")
    recent = _numbered(summaries_overlapping(summaries, start, end, limit // 2), "startTs")
    return ordered_union_distinct([found, _for_each_prompt(prompts, recent)], "id", "position", ["prompt_id"])


def summary_listing_text(candidates: DataFrame, summaries: DataFrame, tz: str = "UTC") -> DataFrame:
    """``(prompt_id, listing, ids)``: the candidates of a prompt as text, in order."""
    def joined(c):
        return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")

    text = F.concat(
        F.lit("["), F.col("id").cast("string"), F.lit("]: "), clock_text("startTs", tz), F.lit(" - "),
        clock_text("endTs", tz), F.lit("\nApps: "), joined("appNames"), F.lit("\nTopics: "), joined("keyTopics"),
        F.lit("\nSummary: "), F.col("summary"))
    rows = candidates.join(summaries, "id").select("prompt_id", "priority", "position", "id", text.alias("text"))
    members = F.sort_array(F.collect_list(F.struct("priority", "position", "id", "text")))
    return rows.groupBy("prompt_id").agg(members.alias("m")).select(
        "prompt_id", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("listing"),
        F.transform("m", lambda x: x["id"]).alias("ids"))


def captures_via_summaries(prompts: DataFrame, captures: DataFrame, summaries: DataFrame, start, end,
                           complete: Complete, params: Params = Params(), templates: Templates = Templates(),
                           model: str = "default", max_tokens: int = 1024, index: TextIndex | None = None,
                           tz: str = "UTC", stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """Path A: captures per prompt, and the judged table ``(prompt_id, ids, relevant)``."""
    cands = candidate_summaries(prompts, summaries, start, end, params.max_summaries, index, stem)
    listing = summary_listing_text(cands, summaries, tz).join(prompts.select("prompt_id", "text"), "prompt_id")
    asked = listing.select("prompt_id", "ids", render_template(
        templates.relevance_user, {"query": F.col("text"), "summaries": F.col("listing")}).alias("prompt"))
    judged = ai_map(asked, "prompt", complete, model, max_tokens, templates.relevance_system)
    judged = judged.withColumn("relevant", parse_relevant_ids("reply", "ids"))
    relevant = judged.select("prompt_id", F.explode(F.array_distinct("relevant")).alias("id"))
    return resolve_captures(captures, summaries, relevant, ["prompt_id"], params.resolve_limit), judged


def unsummarized_candidates(prompts: DataFrame, captures: DataFrame, start, end, limit: int = 50,
                            index: TextIndex | None = None, stem: bool = True) -> DataFrame:
    """Path B ``(prompt_id, id, priority, position)``: of the ``limit / 2`` best search hits those no
    summary covers, then the latest uncovered captures of the range."""
    index = index or capture_index(captures, stem)
    hits = search_many(index, prompts, limit // 2, "prompt_id").select(
        F.col("query_id").alias("prompt_id"), "id", "position")
    waiting = captures.filter(~F.col("isSummarized")).select("id")
    found = hits.join(waiting, "id", "left_semi")
    recent = _numbered(unsummarized_between(captures, start, end, limit // 2), "ts")
    return ordered_union_distinct([found, _for_each_prompt(prompts, recent)], "id", "position", ["prompt_id"])


def context_texts(prompts: DataFrame, captures: DataFrame, summaries: DataFrame, start, end, complete: Complete,
                  params: Params = Params(), templates: Templates = Templates(), model: str = "default",
                  max_tokens: int = 1024, tz: str = "UTC", stem: bool = True,
                  indexes: tuple[TextIndex, TextIndex] | None = None) -> DataFrame:
    """``(prompt_id, text, context, captures_examined, summaries_searched, pass1_error)``."""
    s_index, c_index = indexes or (None, None)
    via, judged = captures_via_summaries(prompts, captures, summaries, start, end, complete, params, templates,
                                         model, max_tokens, s_index, tz, stem)
    direct = unsummarized_candidates(prompts, captures, start, end, params.max_captures, c_index, stem)
    cols = ["prompt_id", "id", "ts"]
    b = direct.select("prompt_id", "id").join(captures.select("id", "ts"), "id").select(cols)
    # At most ``max_captures`` ids for each prompt; read for the rows and for the counts.
    picked = stored(merge_candidates(via.select(cols), b, params.max_captures, ["prompt_id"]))
    rows = picked.select("prompt_id", "id").join(captures, "id")
    # No key has more than ``max_captures`` rows here, so nothing needs to be measured or cut.
    text = format_hierarchical(rows, ["prompt_id"], params.enrich_max_keyframes, params.enrich_max_deltas,
                               params.enrich_keyframe_chars, params.enrich_delta_chars, tz, cut=False)
    counts = picked.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("captures_examined"))
    searched = judged.select("prompt_id", F.size("ids").alias("summaries_searched"), F.col("error").alias("pass1_error"))
    return (prompts.select("prompt_id", "text")
            .join(text.withColumnRenamed("text", "context").join(counts, "prompt_id"), "prompt_id", "left")
            .join(searched, "prompt_id", "left")
            .withColumn("captures_examined", F.coalesce("captures_examined", F.lit(0)))
            .withColumn("summaries_searched", F.coalesce("summaries_searched", F.lit(0))))


def _second_call(contexts: DataFrame, user: str, system: str, complete: Complete, model: str, max_tokens: int) -> DataFrame:
    """Calls the model for prompts with context; the others keep a null reply."""
    asked = contexts.withColumn("prompt", F.when(F.col("captures_examined") > 0, render_template(
        user, {"query": F.col("text"), "captures": F.col("context")})))
    # Stored once: both branches below read the same rows.
    asked = durable(asked)
    some = ai_map(asked.filter(F.col("prompt").isNotNull()), "prompt", complete, model, max_tokens, system)
    none = asked.filter(F.col("prompt").isNull())
    return some.unionByName(none, allowMissingColumns=True)


def enrich(prompts: DataFrame, captures: DataFrame, summaries: DataFrame, start, end, complete: Complete,
           params: Params = Params(), templates: Templates = Templates(), model: str = "default",
           max_tokens: int = 2048, tz: str = "UTC", stem: bool = True,
           indexes: tuple[TextIndex, TextIndex] | None = None) -> DataFrame:
    """Prompts with footnotes appended, or with a note that nothing was found. Blank prompts are
    rejected: they do not appear in the result."""
    prompts = prompts.filter(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    contexts = context_texts(prompts, captures, summaries, start, end, complete, params, templates, model,
                             max_tokens, tz, stem, indexes)
    replies = _second_call(contexts, templates.footnotes_user, templates.footnotes_system, complete, model, max_tokens)
    notes = F.coalesce("reply", F.lit(""))
    return replies.select(
        "prompt_id", F.col("text").alias("originalPrompt"),
        F.when(notes == "", F.concat("text", F.lit(NO_CONTEXT)))
        .otherwise(F.concat("text", F.lit(CONTEXT_HEADING), notes)).alias("enrichedPrompt"),
        "summaries_searched", "captures_examined", F.coalesce("pass1_error", "error").alias("error"))


def query_citations(prompts: DataFrame, captures: DataFrame, summaries: DataFrame, start, end, now,
                    complete: Complete, params: Params = Params(), templates: Templates = Templates(),
                    model: str = "default", max_tokens: int = 2048, tz: str = "UTC", stem: bool = True,
                    indexes: tuple[TextIndex, TextIndex] | None = None) -> DataFrame:
    """Same retrieval; the second call returns citations. Blank queries are rejected, as in ``enrich``."""
    prompts = prompts.filter(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    contexts = context_texts(prompts, captures, summaries, start, end, complete, params, templates, model,
                             max_tokens, tz, stem, indexes)
    replies = _second_call(contexts, templates.citations_user, templates.citations_system, complete, model, max_tokens)
    found = parse_citations(F.coalesce("reply", F.lit("[]")), iso_format(instant(now)))
    return replies.select("prompt_id", "text", found.alias("citations"), "summaries_searched", "captures_examined",
                          F.coalesce("pass1_error", "error").alias("error"))


class Strategy(Protocol):
    """A way to retrieve context for a table of prompts."""

    def __call__(self, prompts: DataFrame, captures: DataFrame, summaries: DataFrame, start, end,
                 complete: Complete, **options) -> DataFrame: ...


STRATEGIES: dict[str, Strategy] = {"two_pass": enrich, "citations": query_citations}
