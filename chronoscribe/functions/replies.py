"""Columns that read the JSON replies of a language model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoscribe.functions.text import _c, let, strip_code_fences


def _document(col: str | Column, body) -> Column:
    """``body`` of the parsed reply; the text is cleaned and parsed once."""
    return let(F.try_parse_json(strip_code_fences(col)), body)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text_member(v: Column, name: str) -> Column:
    """String member, or null when it is absent or of another type."""
    m = _member(v, name)
    return F.when(_kind(m) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _objects(v: Column) -> Column:
    """Members of an array that holds nothing but objects; anything else gives an empty array."""
    none = F.array().cast("array<variant>")

    def only_objects(items: Column) -> Column:
        plain = ~F.exists(items, lambda x: x.isNull() | ~_kind(x).startswith("OBJECT"))
        return F.when(items.isNotNull() & plain, items).otherwise(none)

    return F.when(_kind(v).startswith("ARRAY"), let(F.try_variant_get(v, "$", "array<variant>"), only_objects)).otherwise(none)


def parse_summary(col: str | Column) -> Column:
    """``struct(summary, keyTopics)``. No string ``summary``: the raw reply. ``key_topics`` counts
    only when every member is a string."""
    none = F.array().cast("array<string>")

    def topics(v: Column) -> Column:
        def all_strings(values: Column) -> Column:
            return F.when(~F.exists(values, lambda x: x.isNull()), values)

        strings = _kind(_member(v, "key_topics")) == "ARRAY<STRING>"
        return F.when(strings, let(F.try_variant_get(v, "$.key_topics", "array<string>"), all_strings))

    def read(v: Column) -> Column:
        is_object = _kind(v).startswith("OBJECT")
        return F.struct(F.when(is_object, _text_member(v, "summary")).alias("summary"),
                        F.coalesce(F.when(is_object, topics(v)), none).alias("keyTopics"))

    return let(F.struct(_c(col).alias("raw"), _document(col, read).alias("p")), lambda r: F.struct(
        F.coalesce(r["p"]["summary"], r["raw"]).alias("summary"), r["p"]["keyTopics"].alias("keyTopics")))


def parse_relevant_ids(col: str | Column, valid: str | Column) -> Column:
    """``array<bigint>`` of the ``id`` members found in ``valid``; order and repeats are kept,
    fractions are cut off."""
    def to_id(x: Column) -> Column:
        kind = _kind(_member(x, "id"))
        whole = F.try_variant_get(x, "$.id", "bigint")
        part = F.try_variant_get(x, "$.id", "double").cast("long")
        real = (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
        return F.when(kind == "BIGINT", whole).when(real, part)

    ids = _document(col, lambda v: F.transform(_objects(v), to_id))
    return F.filter(ids, lambda i: i.isNotNull() & F.array_contains(_c(valid), i))


def parse_citations(col: str | Column, now: Column) -> Column:
    """Array of citations. An item needs ``relevant_text`` and ``relevance_explanation``; the other
    members have defaults. ``now`` is ISO text."""
    def citation(x: Column) -> Column:
        return F.struct(
            F.coalesce(_text_member(x, "timestamp"), now).alias("timestamp"),
            F.coalesce(_text_member(x, "app_name"), F.lit("Unknown")).alias("app_name"),
            _text_member(x, "window_title").alias("window_title"),
            _text_member(x, "relevant_text").alias("relevant_text"),
            _text_member(x, "relevance_explanation").alias("relevance_explanation"),
            F.coalesce(_text_member(x, "source"), F.lit("capture")).alias("source"))

    items = _document(col, lambda v: F.transform(_objects(v), citation))
    return F.filter(items, lambda c: c["relevant_text"].isNotNull() & c["relevance_explanation"].isNotNull())
