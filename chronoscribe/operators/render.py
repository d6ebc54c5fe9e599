"""Hierarchical keyframe/delta text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscribe.functions.clock import clock_text
from chronoscribe.functions.numbers import whole_percent
from chronoscribe.functions.text import truncate_text
from chronoscribe.operators.runs import Runs
from chronoscribe.operators.sequence import _walk_groups, is_evenly_spaced, is_keyframe

EM_DASH = "—"


def _section(kf_chars: int, delta_chars: int, tz: str) -> Column:
    head = F.concat(F.lit("--- Keyframe ("), clock_text("ts", tz), F.lit(") ["), F.col("appName"),
                    F.lit(f" {EM_DASH} "), F.coalesce("windowTitle", F.lit("Unknown")), F.lit("] ---\n"),
                    truncate_text("__text", kf_chars))
    delta = F.concat(F.lit("--- Delta ("), clock_text("ts", tz), F.lit(") ["),
                     whole_percent("changePercentage").cast("string"), F.lit("% changed] ---\n"),
                     truncate_text("__text", delta_chars))
    return F.when(F.col("__head"), head).when(F.col("__text") != "", delta)


def with_sections(rows: DataFrame, keys: list[str], max_keyframes: int = 10, max_deltas: int = 5,
                  keyframe_chars: int = 3000, delta_chars: int = 500, tz: str = "UTC", **size) -> DataFrame:
    """Add ``section``: the text a row contributes, null for rows that are not sampled.

    Texts are shortened to one character more than the longest that can be shown before the rows
    are shuffled; that is enough to tell whether a text is cut."""
    longest_shown = max(keyframe_chars, delta_chars) + 1
    # A leading delta heads its group, so the head limit applies to it too.
    lean = rows.withColumn("__text", F.substring("ocrText", 1, longest_shown)).drop("ocrText", "fullOcrText")
    one = F.lit(1).cast("long")
    runs = _walk_groups(Runs(lean, keys, **size))
    head = F.col("__head").cast("long")
    runs.running_sum("__g", head).total("__gn", head).position("__pos")
    runs.last_where("__gpos", F.col("__head"), F.col("__pos"))
    runs.with_column("__d", F.col("__pos") - F.col("__gpos") - 1)
    inner_size = size if runs.cut else {**size, "cut": False}
    lean = runs.with_column("__kf_in", is_evenly_spaced(F.col("__g") - 1, F.col("__gn"), max_keyframes)).frame()
    # Groups are parts of the sequences measured above; only cut sequences need a new measure.
    inner = Runs(lean, [*keys, "__g"], **inner_size)
    inner.total("__dn", (~F.col("__head")).cast("long"))
    shown = F.col("__kf_in") & (F.col("__head") | is_evenly_spaced(F.col("__d"), F.col("__dn"), max_deltas))
    inner.with_column("section", F.when(shown, _section(keyframe_chars, delta_chars, tz)))
    return inner.drop("__text", "__head", "__group", "__g", "__gn", "__pos", "__gpos", "__d", "__kf_in", "__dn").frame()


def joined_sections(ts: str = "ts", id: str = "id") -> Column:
    """Aggregate: sections of a key in order, blank lines between. Sampling bounds their number."""
    members = F.collect_list(F.when(F.col("section").isNotNull(), F.struct(F.col(ts), F.col(id), F.col("section"))))
    return F.array_join(F.transform(F.sort_array(members), lambda m: m["section"]), "\n\n")


def format_hierarchical(rows: DataFrame, keys: list[str] = (), max_keyframes: int = 10, max_deltas: int = 5,
                        keyframe_chars: int = 3000, delta_chars: int = 500, tz: str = "UTC", **size) -> DataFrame:
    """One row per key with ``text``."""
    keys = list(keys)
    parts = with_sections(rows, keys, max_keyframes, max_deltas, keyframe_chars, delta_chars, tz, **size)
    return parts.groupBy(*keys).agg(joined_sections().alias("text"))
