"""Benchmark decontamination by winnowing.

The fingerprints of a text are the hashes of ``K`` words that are least in some window of ``WINDOW``
neighbouring hashes. Two texts that share ``K + WINDOW - 1`` (10) consecutive words share a fingerprint
at the same place of the shared words. Fingerprints of documents and of benchmark items are joined, and
each meeting is extended to the runs of 10 words around it, which are compared by hash with those of the
items. An item of fewer than 10 words is one run; its own hash is its fingerprint.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case. Defined cases: a null text
has no words; a null item id counts as an empty one; rows of one item id count once; repeated document
rows are answered one by one; empty tables give no hits; other columns of the inputs are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common

RUN, K = 10, 5
WINDOW = RUN - K + 1
#: Slots of the bitmap that keeps documents' fingerprints which no item has out of the join: 512 KiB at any size.
SLOTS = 1 << 22

_MARKS = "array<struct<kind:int,fingerprint:bigint,start:array<int>,run:array<bigint>>>"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = common.folded(data)
    inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    starts, ends, text = common.runs(inside, off)
    return common.Spans(data).of(starts, ends), text


def _grams(spans: common.Spans, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words, and whether all are of one text."""
    h = spans.grams(n)
    return h, (text[:len(h)] == text[n - 1:]) if len(h) else np.zeros(0, bool)


def chosen(h: np.ndarray, real: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose hash is the least of a window of places that has it; all of a tie."""
    v = np.where(real, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    n = len(v) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = v[:n].copy()
    for k in range(1, window):
        np.minimum(least, v[k:n + k], out=least)
    pick = np.zeros(len(v), bool)
    for k in range(window):
        pick[k:n + k] |= v[k:n + k] == least
    return np.flatnonzero(pick & real)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, kind, fingerprint, run): kind is the number of words of the run."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                            common.text_of(benchmark, text).alias("text"))

    def run(batches):
        for piece in common.pieces(batches, "text"):
            words, of = _words(*common.raw(common.column(piece, "text")))
            spans, size = common.Spans(words), np.bincount(of, minlength=piece.num_rows)
            h, real = _grams(spans, of, K)
            r, whole = _grams(spans, of, RUN)
            out = []
            for p in chosen(h, real):
                for s in range(max(0, p - WINDOW + 1), min(p + 1, len(r))):
                    if whole[s] and of[s] == of[p]:
                        out.append((of[p], RUN, h[p], r[s]))
            first = np.searchsorted(of, np.arange(piece.num_rows))
            short = np.flatnonzero((size > 0) & (size < RUN))
            own = spans.of(first[short], first[short] + size[short])
            out += [(t, size[t], x, x) for t, x in zip(short, own)]
            a = np.array(out, np.uint64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [common.column(piece, "item").take(pa.array(a[:, 0].astype(np.int64))), pa.array(a[:, 1].astype(np.int32)),
                 pa.array(a[:, 2].view(np.int64)), pa.array(a[:, 3].view(np.int64))], ["item", "kind", "fingerprint", "run"])

    return common.cut(rows.mapInArrow(run, "item string, kind int, fingerprint bigint, run bigint").distinct())


def _bitmap(items: DataFrame) -> np.ndarray:
    """One bit for each slot that has a fingerprint. What comes to the driver is at most SLOTS numbers."""
    slots = items.select(F.pmod("fingerprint", F.lit(SLOTS)).alias("slot")).distinct().toPandas()["slot"].to_numpy()
    bits = np.zeros(SLOTS, bool)
    bits[slots.astype(np.int64)] = True
    return np.packbits(bits)


def _marked(docs: DataFrame, keep: list[str], text: str, items: DataFrame) -> DataFrame:
    """``keep`` columns, a row number, the number of words, and the fingerprints that may meet an item, each
    with the runs around it."""
    short = sorted(r[0] for r in items.filter(F.col("kind") < RUN).select("kind").distinct().collect())  # at most 9
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                       F.monotonically_increasing_id().alias("row"), common.text_of(docs, text).alias("text"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches):
        bits = np.unpackbits(bitmap.value).view(bool)
        for piece in common.pieces(batches, "text"):
            words, of = _words(*common.raw(common.column(piece, "text")))
            spans, n = common.Spans(words), piece.num_rows
            first = np.searchsorted(of, np.arange(n))
            h, real = _grams(spans, of, K)
            p = chosen(h, real)
            p = p[bits[h[p] & np.uint64(SLOTS - 1)]]
            r, whole = _grams(spans, of, RUN)
            starts = p[:, None] - np.arange(WINDOW)[None, :]
            good = (starts >= 0) & (starts < len(r))
            good[good] = whole[starts[good]]
            good &= of[np.where(good, starts, 0)] == of[p][:, None] if len(of) else good
            kind, mark, at, count = [np.full(len(p), RUN, np.int32)], [h[p]], [p], [good.sum(1)]
            for m in short:
                g, one = _grams(spans, of, m)
                q = np.flatnonzero(one & bits[g & np.uint64(SLOTS - 1)])
                kind.append(np.full(len(q), m, np.int32)), mark.append(g[q]), at.append(q), count.append(np.ones(len(q), np.int64))
            sizes = [len(x) for x in at]
            kind, mark, at, count = map(np.concatenate, (kind, mark, at, count))
            run_at = np.concatenate([starts[good], at[sizes[0]:]])
            run_hash = np.concatenate([r[starts[good]], mark[sizes[0]:]])
            owner = np.repeat(np.arange(len(at)), count)
            order = np.argsort(of[at], kind="stable")
            place = np.empty(len(at), np.int64)
            place[order] = np.arange(len(at))
            inner = np.argsort(place[owner], kind="stable")
            ends = np.concatenate([[0], np.cumsum(count[order])]).astype(np.int32)
            rel = (run_at[inner] - first[of[run_at[inner]]]).astype(np.int32) if len(inner) else np.zeros(0, np.int32)
            marks = pa.StructArray.from_arrays(
                [pa.array(kind[order]), pa.array(mark[order].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(rel)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(run_hash[inner].view(np.int64)))],
                ["kind", "fingerprint", "start", "run"])
            edges = np.concatenate([[0], np.cumsum(np.bincount(of[at], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array(np.bincount(of, minlength=n)), pa.ListArray.from_arrays(pa.array(edges), marks)],
                [*piece.schema.names[:-1], "n_words", "marks"])

    return common.cut(rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}row bigint, n_words bigint, marks {_MARKS}"))


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """Per document row: columns ``keep``, ``n_words``, ``n_hit`` (words inside a run that an item has),
    ``items`` (sorted ids of the items whose runs occur) and ``spans`` (maximal hit ranges, in words)."""
    found = _found(docs, benchmark, keep, text, item, item_text)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "items", "spans")


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str, item: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """As ``find``, with the kept columns as c0, c1, ..."""
    items = _items(benchmark, item, item_text)
    rows = _marked(docs, keep, text, items)
    met = rows.select("row", F.explode("marks").alias("m")).select("row", "m.*").join(
        items.select("kind", "fingerprint").distinct(), ["kind", "fingerprint"], "left_semi")
    around = met.select("row", "kind", F.explode(F.arrays_zip("start", "run")).alias("r")).select(
        "row", "kind", "r.start", "r.run")
    hits = around.join(items.select("kind", "run", "item").distinct(), ["kind", "run"])
    # One array for each document: its hit runs and items, at most its words and the items.
    per_row = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind"))).alias("runs"),
                                      F.sort_array(F.collect_set("item")).alias("items"))
    merged = F.expr("""aggregate(runs, cast(array() as array<struct<from: int, to: int>>), (a, r) -> CASE
        WHEN size(a) > 0 AND a[size(a) - 1].to >= r.start THEN concat(slice(a, 1, size(a) - 1), array(named_struct(
            'from', a[size(a) - 1].from, 'to', greatest(a[size(a) - 1].to, r.start + r.kind))))
        ELSE concat(a, array(named_struct('from', r.start, 'to', r.start + r.kind))) END)""")
    per_row = per_row.select("row", "items", merged.alias("spans"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    return rows.drop("marks").join(per_row, "row", "left").select(
        *[f"c{i}" for i in range(len(keep))], "n_words",
        F.coalesce(F.expr("aggregate(spans, 0L, (a, s) -> a + s.to - s.from)"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def drop_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that share no run of words with an item."""
    clean = _found(docs, benchmark, docs.columns, text).filter("n_hit = 0")
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
