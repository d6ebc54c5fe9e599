"""Text functions: normalising, hashing, word-set similarity, tokens, truncation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token starts with a letter, number or private-use character and goes on over
# those and combining marks; everything else separates.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col: str | Column) -> Column:
    """Lower case, runs of Unicode white space to one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), r"(?U)\s+", " "))


def text_hash(col: str | Column) -> Column:
    """SHA-256 of the UTF-8 bytes as lower-case hex."""
    return F.sha2(_c(col), 256)


def dedup_hash(col: str | Column) -> Column:
    return text_hash(normalize_text(col))


def word_set(col: str | Column) -> Column:
    """Distinct words of the normalised text; empty text has no words."""
    norm = normalize_text(col)
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(norm, " ")))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / union)


def jaccard_similarity(a: str | Column, b: str | Column) -> Column:
    """Word-set Jaccard of two texts; two empty texts are equal (1.0)."""
    return jaccard_of_sets(word_set(a), word_set(b))


def is_near_duplicate(a: str | Column, b: str | Column, threshold: float = 0.9) -> Column:
    """Equal normalised hash, or word-set Jaccard at or above ``threshold``."""
    same = dedup_hash(a) == dedup_hash(b)
    return same | (jaccard_similarity(a, b) >= F.lit(float(threshold)))


def truncate_text(col: str | Column, limit: int) -> Column:
    """Text longer than ``limit`` becomes its prefix and an ellipsis of three dots."""
    c = _c(col)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def preview(col: str | Column, chars: int) -> Column:
    """First characters on one line."""
    return F.translate(F.substring(_c(col), 1, chars), "\n", " ")


def raw_tokens(col: str | Column) -> Column:
    """Lower-cased tokens in order, without folding and stemming."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def ascii_lower(col: str | Column) -> Column:
    return F.translate(_c(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_contains(col: str | Column, part: str) -> Column:
    """``LIKE %part%`` that ignores ASCII case only; ``%`` and ``_`` in ``part`` stay wildcards."""
    lowered = part.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    pattern = "%" + lowered.replace("\\", "\\\\") + "%"
    return ascii_lower(col).like(pattern)


def render_template(template: str, values: dict[str, str | Column]) -> Column:
    """Replace every ``{name}`` of ``values`` once, left to right; other braces stay."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values]
        hits = [h for h in hits if h[0] >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, key = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(_c(values[key]))
        rest = rest[at + len(key) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_code_fences(col: str | Column) -> Column:
    """Trim; drop an opening fence line and a closing fence; trim again."""
    s = _c(col)
    for pattern in (r"(?U)\A\s+|\s+\z", r"\A```[^\n]*\n", r"```\z", r"(?U)\A\s+|\s+\z"):
        s = F.regexp_replace(s, pattern, "")
    return s
