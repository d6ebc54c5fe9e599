"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions (nodes 1 to 255 of a binary tree); each decision has contexts of 0 to
``DEPTH`` bytes before it. A context's Krichevsky-Trofimov estimate is mixed, half and half in the prior,
with the product of its longer contexts. After training the tree is fixed: a decision's probability mixes the
estimates of all its contexts with their posterior weights, so that a byte's probability depends on the
``DEPTH`` bytes before it and a text is a sum over its byte runs of ``DEPTH + 1``.

Texts are read in blocks of bounded size. A block gives its distinct runs and words with their training
counts; these are summed over all blocks by Spark, the tree is built from the sums by joins and
aggregations, and each block gets back the numbers of its own runs and words. No model is gathered
anywhere. Texts start with bytes 0xFF, which UTF-8 lacks, and end with one that is scored.

Letters A-Z count as lower case. Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null text is an empty
one; repeated rows count as often as they stand; with no training text every decision has probability one
half and no token is known; a text of any length is scored whole; an empty table gives no rows; columns
not named in ``keep`` are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscribe.llm import common

DEPTH = 4
#: Bytes of text in a block, and of those that are worked on at a time.
BLOCK, STEP = 24 << 20, 1 << 20
WORDS, RUNS = 0, 1
#: Stands for the end of a text among word hashes.
END = np.uint64(0x0E5D0F7E87A1B2C3)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, and their text numbers."""
    starts, ends, text = common.runs(~common.blank(data), off)
    n = len(off) - 1
    return (np.concatenate([common.Spans(data).of(starts, ends), np.full(n, END)]), np.concatenate([text, np.arange(n)]))


def byte_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of ``DEPTH + 1`` bytes that ends at each byte of each text and at its end mark, as numbers with
    the latest byte lowest, and their text numbers."""
    n, mark = len(off) - 1, b"\xff"
    texts = [data[off[i]:off[i + 1]].tobytes() for i in range(n)]
    out = np.frombuffer(mark * DEPTH + (mark * (DEPTH + 1)).join(texts) + mark, np.uint8).astype(np.uint64)
    key = np.zeros(len(out) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        key = (key << np.uint64(8)) | out[k:len(out) - DEPTH + k]
    real = np.ones(len(key), bool)  # but for the marks in front of a text
    end = off[1:-1] + np.arange(n - 1) * (DEPTH + 1)
    for k in range(1, DEPTH + 1):
        real[end + k] = False
    return key[real], np.repeat(np.arange(n), np.diff(off) + 1)


class _Counts:
    """Distinct keys of many pieces and how often each stands in training texts."""

    def __init__(self):
        self.keys, self.counts = [], []

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        code, distinct = pd.factorize(keys)
        self.keys.append(distinct)
        self.counts.append(np.bincount(code[train], minlength=len(distinct)))

    def rows(self, block: int, kind: int):
        code, distinct = pd.factorize(np.concatenate(self.keys))
        n = np.bincount(code, np.concatenate(self.counts), len(distinct)).astype(np.int64)
        for at in range(0, len(distinct), 100_000):
            k = distinct[at:at + 100_000].view(np.int64)
            yield _rows(np.full(len(k), block), kind, k, n[at:at + 100_000], None)


def _rows(block, kind, key, n, data) -> pa.RecordBatch:
    size = len(block)
    none = lambda t: pa.nulls(size, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(block), none(pa.int32()) if kind is None else pa.array(np.full(size, kind, np.int32)), none(pa.int64()) if key is None else pa.array(key),
         none(pa.int64()) if n is None else pa.array(n), none(pa.binary()) if data is None else pa.array([data], pa.binary())],
        ["block", "kind", "key", "n", "data"])


def blocks(docs: DataFrame, keep: list[str], text: str, held_out: Column) -> DataFrame:
    """A stored table with a row (block, data) for each block of texts, compressed, and rows (block, kind, key, n) for
    its distinct words and byte runs."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), common.text_of(docs, text).alias("text"))
    limit = BLOCK

    def run(batches):
        task, i = TaskContext.get().taskAttemptId() << 24, 0
        held, size = [], 0

        def emit(block):
            sink, words, byte = pa.BufferOutputStream(), _Counts(), _Counts()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for piece in held:
                    w.write_batch(piece)
                    data, off = common.raw(common.column(piece, "text"))
                    data = common.folded(data)
                    train = ~common.column(piece, "held_out").to_numpy(zero_copy_only=False)
                    for count, (keys, of) in ((words, word_hashes(data, off)), (byte, byte_runs(data, off))):
                        count.add(keys, train[of])
            yield _rows([block], None, None, None, sink.getvalue().to_pybytes())
            yield from words.rows(block, WORDS)
            yield from byte.rows(block, RUNS)

        for piece in common.pieces(batches, "text", min(limit, STEP)):
            held.append(piece)
            size += common.column(piece, "text").nbytes
            if size >= limit:
                yield from emit(task + i)
                held, size, i = [], 0, i + 1
                pa.default_memory_pool().release_unused()
        if held:
            yield from emit(task + i)

    return common.cut(rows.mapInArrow(run, "block bigint, kind int, key bigint, n bigint, data binary"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back."""
    y = x + 8
    low = F.lit(0.0)
    for k in range(8):
        low = low + F.ln(x + k)
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - low


def _estimate(n0: Column, n1: Column) -> Column:
    """Log probability of the decisions seen, by the Krichevsky-Trofimov estimator."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - F.lit(2 * math.lgamma(0.5))


def _decisions(runs: DataFrame) -> DataFrame:
    """The eight decisions of each run: (context, node, bit)."""
    byte = F.col("key").bitwiseAND(F.lit(255))
    made = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(
        F.call_function("shiftleft", F.lit(1), k).bitwiseOR(F.call_function("shiftright", byte, 8 - k).cast("int")).alias("node"),
        F.call_function("shiftright", byte, 7 - k).bitwiseAND(F.lit(1)).cast("int").alias("bit")))
    return runs.select("*", F.shiftright("key", 8).alias("context"), F.explode(made).alias("d")).select("*", "d.node", "d.bit").drop("d")


def model(totals: DataFrame, depth: int = DEPTH) -> DataFrame:
    """From (key, n) of all byte runs: (key, ln p), the log probability of each run's last byte."""
    parts = _decisions(totals)
    level = parts.groupBy("context", "node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    level = level.withColumn("own", _estimate(F.col("n0"), F.col("n1"))).withColumn("all", F.col("own")).withColumn("weight", F.lit(1.0))
    levels = [common.cut(level)]
    for d in range(depth - 1, -1, -1):
        up = levels[-1].groupBy(F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("context"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("all").alias("longer"))
        up = up.withColumn("own", _estimate(F.col("n0"), F.col("n1")))
        high, low = F.greatest("own", "longer"), F.least("own", "longer")
        up = up.withColumn("all", high + F.log1p(F.exp(low - high)) - math.log(2))
        up = up.withColumn("weight", 1 / (1 + F.exp(F.col("longer") - F.col("own"))))
        levels.append(common.cut(up))
    odds = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    p = levels[0].select("context", "node", odds.alias("p"))
    for d, up in zip(range(depth - 1, -1, -1), levels[1:]):
        up = up.select(F.col("context").alias("shorter"), "node", "weight", odds.alias("q"))
        if d <= 1:
            up = F.broadcast(up)  # at most 256 * 255 rows
        p = p.withColumn("shorter", F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(up, ["shorter", "node"]).select(
            "context", "node", (F.col("weight") * F.col("q") + (1 - F.col("weight")) * F.col("p")).alias("p"))
    return parts.select("key", "context", "node", "bit").join(p, ["context", "node"]).groupBy("key").agg(
        F.sum(F.ln(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("value"))


def score(docs: DataFrame, keep: list[str], held_out: Column, text: str = "text") -> DataFrame:
    """Per row: ``keep``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram),
    ``score`` (log10 probability of the text by the tree) and ``bits_per_byte``. Learns from rows that are not held out."""
    table = blocks(docs, keep, text, held_out)
    entries = table.filter("data IS NULL")
    runs = entries.filter(F.col("kind") == RUNS).select("block", "key", "n")
    tree = common.cut(model(common.cut(runs.groupBy("key").agg(F.sum("n").alias("n")))))
    runs = runs.join(tree, "key").select(F.col("block").alias("block"), F.lit(RUNS).alias("kind"), "key", "value")
    by_word = Window.partitionBy("key")
    words = entries.filter(F.col("kind") == WORDS).select("block", "key", "n", F.sum("n").over(by_word).alias("c"),
                                                          F.row_number().over(by_word.orderBy("block")).alias("i"))
    words = common.cut(words)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if((F.col("i") == 1) & (F.col("c") > 0)).alias("distinct"))
    total, distinct = (int(x) for x in sums.first())
    answers = runs.unionByName(words.select("block", F.lit(WORDS).alias("kind"), "key", F.col("c").cast("double").alias("value")))
    texts = table.filter("data IS NOT NULL").select(F.col("block").alias("block"), "data")
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, key, value = (right.column(c).to_numpy() for c in ("kind", "key", "value"))
        key = key.view(np.uint64)
        found = []
        for k in (WORDS, RUNS):
            mine = kind == k
            order = np.argsort(key[mine])
            found.append((key[mine][order], value[mine][order]))
        out = []
        for stored in left.column("data").to_pylist():
            for batch in pa.ipc.open_stream(stored):
                data, off = common.raw(common.column(batch, "text"))
                data, n = common.folded(data), batch.num_rows
                keys, of = word_hashes(data, off)
                code, seen = pd.factorize(keys)
                c = found[WORDS][1][np.searchsorted(found[WORDS][0], seen)][code]
                base = np.bincount(of, np.log10((c + 1) / (total + 1 * (distinct + 1))), n)
                tokens, known = np.bincount(of, minlength=n), np.bincount(of[c > 0], minlength=n)
                keys, of = byte_runs(data, off)
                code, seen = pd.factorize(keys)
                nats = np.bincount(of, found[RUNS][1][np.searchsorted(found[RUNS][0], seen)][code], n)
                out.append(pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(keep))], common.column(batch, "held_out"), pa.array(tokens), pa.array(known),
                     pa.array(np.full(n, total)), pa.array(base), pa.array(nats / math.log(10)),
                     pa.array(-nats / math.log(2) / np.maximum(1, np.diff(off)))],
                    [*[f"c{i}" for i in range(len(keep))], "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]))
        return pa.Table.from_batches(out)

    done = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"{kinds}{', ' if kinds else ''}held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
             "score double, bits_per_byte double")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "held_out", "n_tokens", "n_known", "train_tokens",
                       "base_score", "score", "bits_per_byte")
