"""Quality rules as a bitmask ledger.

``ledger`` reads each text once, keeps what the rules measure and one bit for each rule that fails.
Policies are named sets of rules with a version; they are applied to the stored bits, so that another
policy, or the effect of leaving a rule out (``ablation``), never reads a text again.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null text is an empty one and fails ``few_words``;
repeated rows are judged alike, each by itself; a text of any length is one row; an empty table gives an
empty ledger; columns of the input with the names used here are kept, the ledger then gets a free name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common

FIELDS = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_lines:bigint,n_dup_lines:bigint,"
          "n_repeat_words:bigint,n_alpha_words:bigint,longest_word:bigint>")
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails``, SQL over the measurements, is true."""

    name: str
    fails: str


#: Bit i belongs to the i-th rule; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "n_symbols > 0.3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("no_letters", "100 * n_alpha_words < 50 * n_words"),
)

#: Versions of what a document has to pass.
POLICIES = {
    "base-1": ("few_words", "repeated_phrases"),
    "full-1": tuple(r.name for r in RULES),
}
POLICY = "full-1"


def measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    white = common.blank(data)
    starts, ends, text = common.runs(~white, off)
    lead = (data & 0xC0) != 0x80
    symbol = np.isin(data, SYMBOLS)
    letter = (((data | 32) >= 97) & ((data | 32) <= 122)) | (data >= 128)
    n_words = np.bincount(text, minlength=n)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=letters[1:])
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    alpha = np.bincount(text[letters[ends] > letters[starts]], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, points[ends] - points[starts])
    spans = common.Spans(data)

    # Lines: from a text's start or a newline to the next newline or the end; a text has one at least.
    newline = np.flatnonzero(data == 10)
    line_text = np.concatenate([np.arange(n), np.searchsorted(off, newline, "right") - 1])
    line_start = np.concatenate([off[:-1], newline + 1])
    order = np.lexsort((line_start, line_text))
    line_text, line_start = line_text[order], line_start[order]
    line_end = np.empty(len(line_start), np.int64)
    last = np.ones(len(line_start), bool)
    last[:-1] = line_text[1:] != line_text[:-1]
    line_end[:-1] = line_start[1:] - 1
    line_end[last] = off[1:][line_text[last]]
    full = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~white, out=full[1:])
    worded = full[line_end] > full[line_start]
    line_text, line_start, line_end = line_text[worded], line_start[worded], line_end[worded]
    _, earlier = common.repeated(common.within(spans.of(line_start, line_end), line_text))
    dup_lines = np.bincount(line_text[earlier], minlength=n)

    # Windows of three words that the text has twice or more mark all their words.
    grams = common.Spans(spans.of(starts, ends)).grams(3)
    one_text = text[:len(grams)] == text[2:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(one_text)
    again, _ = common.repeated(common.within(grams[at], text[at]))
    hit = np.zeros(len(starts), bool)
    for k in range(3):
        hit[at[again] + k] = True
    return [n_words, common.per_text(lead & ~white, off), common.per_text(symbol, off),
            np.bincount(line_text, minlength=n), dup_lines, np.bincount(text[hit], minlength=n), alpha, longest]


def ledger(docs: DataFrame, text: str = "text", name: str = "ledger") -> DataFrame:
    """``docs`` with a struct ``name``: all measurements and ``failures``, the bits of the rules that fail."""
    name = common.fresh(docs, name)
    out = common.with_struct(docs, text, name, FIELDS, measure)
    bits = None
    for i, rule in enumerate(RULES):
        bit = F.when(F.expr(_of(rule.fails, name)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return out.withColumn(name, F.col(f"`{name}`").withField("failures", bits))


def _of(sql: str, name: str) -> str:
    for field in sorted({f.split(":")[0] for f in FIELDS[7:-1].split(",")}, key=len, reverse=True):
        sql = " ".join(f"`{name}`.{w}" if w == field else w for w in sql.split(" "))
    return sql


def mask(policy: str) -> int:
    """The bits a policy looks at."""
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[policy])


def failed(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) != 0


def ablation(rows: DataFrame, bits: str = "failures", policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: documents it fails, documents only it fails (those that come back without
    it), and documents that fail together with it, as bits of the other rules."""
    b = F.col(bits).bitwiseAND(F.lit(mask(policy)))
    own = [(i, r) for i, r in enumerate(RULES) if r.name in POLICIES[policy]]
    sums = []
    for i, _ in own:
        one = b.bitwiseAND(F.lit(1 << i)) != 0
        sums += [F.count_if(one).alias(f"n{i}"), F.count_if(b == (1 << i)).alias(f"only{i}"),
                 F.bit_or(F.when(one, b.bitwiseAND(F.lit(~(1 << i))))).alias(f"with{i}")]
    row = rows.agg(F.count(F.lit(1)).alias("documents"), *sums)
    return row.select("documents", F.explode(F.array(*[
        F.struct(F.lit(policy).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("n_failed"),
                 F.col(f"only{i}").alias("n_failed_only"), F.coalesce(f"with{i}", F.lit(0)).alias("fails_with"))
        for i, r in own])).alias("r")).select("documents", "r.*")


def keep(docs: DataFrame, text: str = "text", policy: str = POLICY) -> DataFrame:
    """The rows of ``docs``, unchanged, that pass ``policy``."""
    name = common.fresh(docs, "ledger")
    out = ledger(docs, text, name)
    return out.filter(~failed(F.col(f"`{name}`.failures"), policy)).select(*[f"`{c}`" for c in docs.columns])
