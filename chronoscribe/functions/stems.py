"""Porter (1980) stemming and diacritic folding of token arrays.

The work is done on the dictionary of each Arrow batch: every distinct token of
the batch is stemmed once, most by no call at all, and the token arrays are rebuilt by index.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Suffix rules of the published algorithm, longest match first.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
          "ate", "iti", "ous", "ive", "ize"]


_KINDS = {i: "c" for i in range(256)} | {ord(v): "v" for v in "aeiou"} | {ord("y"): "y"}


def _kinds(w: str) -> str:
    """``c`` or ``v`` for each letter of a Latin-1 word; a y is a vowel where it follows a consonant."""
    kinds = w.translate(_KINDS)
    at = kinds.find("y")
    while at >= 0:
        kinds = kinds[:at] + ("v" if at and kinds[at - 1] == "c" else "c") + kinds[at + 1:]
        at = kinds.find("y", at)
    return kinds


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _double_consonant(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and w[-1] not in "wxy" and _kinds(w)[-3:] == "cvc"


def _replace(w: str, rules: list[tuple[str, str]], ends: tuple[str, ...]) -> str:
    if not w.endswith(ends):
        return w
    suffix, new = max([r for r in rules if w.endswith(r[0])], key=lambda r: len(r[0]))
    stem = w[:-len(suffix)]
    return stem + new if _measure(stem) > 0 else w


_ENDS_2, _ENDS_3, _ENDS_4 = tuple(s for s, _ in STEP_2), tuple(s for s, _ in STEP_3), tuple(STEP_4)


def porter(w: str) -> str:
    """Stem of one lower-case word."""
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    trimmed = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        trimmed = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        trimmed = w[:-3]
    if trimmed is not None:
        w = trimmed
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_consonant(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"

    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"

    w = _replace(_replace(w, STEP_2, _ENDS_2), STEP_3, _ENDS_3)

    if w.endswith(_ENDS_4):
        suffix = max([s for s in STEP_4 if w.endswith(s)], key=len)
        stem = w[:-len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            w = stem

    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("l") and _double_consonant(w) and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=None)
def _fold_letter(ch: str) -> str:
    if unicodedata.category(ch) == "Mn":
        return ""
    parts = unicodedata.normalize("NFD", ch)
    return parts[0] if len(parts) == 2 and parts[0].isascii() else ch


def fold(token: str) -> str:
    """Latin letters with one diacritic to the bare letter; combining marks dropped."""
    return token if token.isascii() else "".join(map(_fold_letter, token))


@lru_cache(maxsize=200_000)
def stem(token: str) -> str:
    """Fold, then stem. Tokens under 3 or over 64 bytes keep their folded form."""
    folded = fold(token)
    raw = folded.encode("utf-8")
    if not 3 <= len(raw) <= 64:
        return folded
    # The rules see bytes, so a letter beyond ASCII counts as consonants.
    out = porter(raw.decode("latin-1")).encode("latin-1")
    return out.decode("utf-8", errors="replace")


#: An ASCII word with none of these ends is its own stem: no rule applies to it, so none is reached later either.
_ENDS = "(?:" + "|".join(["s", "ed", "ing", "y", "e", "ll", *{s for s, _ in STEP_2 + STEP_3}, *STEP_4]) + ")$"


def stem_words(words: pa.Array) -> pa.Array:
    """``stem`` of each of an array of words; only those that a rule may change are looked at one by one."""
    words = words.cast(pa.string())
    asked = pc.fill_null(pc.or_(pc.invert(pc.string_is_ascii(words)), pc.match_substring_regex(words, _ENDS)), False)
    return pc.replace_with_mask(words, asked, pa.array([stem(w) for w in words.filter(asked).to_pylist()], pa.string()))


def _map_tokens(tokens: pa.Array, fn) -> pa.Array:
    lists = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    coded = lists.flatten().dictionary_encode()
    values = pc.take(fn(coded.dictionary), coded.indices)
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, values)


@arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    return _map_tokens(tokens, stem_words)
