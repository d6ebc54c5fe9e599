"""Anchored greedy windows: a window starts at a row, and the first row at least
``width`` after that start begins the next one.

Within one task the rows arrive in key and value order and one pass marks the
anchors. A key cut into slices (see ``runs``) is resolved in three steps: each
slice tells, for every row that could be its first anchor, which anchor would be
its last; those maps are composed in a tree (see ``scans``); then every slice is
marked with the anchor it inherits. Only rows in the first ``width`` of a slice can be
its first anchor, and composing two maps keeps it so, so they stay a small part of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoscribe.operators.runs import _SLICE, Runs
from chronoscribe.operators.scans import carried
from chronoscribe.session import stored


def _key_breaks(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """True where a row has other key values than the row before it."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first = tuple(batch.column(k)[0].as_py() for k in keys)
    new[0] = last is None or first != last
    return new, tuple(batch.column(k)[n - 1].as_py() for k in keys)


def _next_start(v: np.ndarray, i: int, n: int, anchor, width, strict: bool) -> int:
    """The first place from ``i`` on whose distance to the anchor opens a window. The search compares sums, so its
    result is set right by the differences themselves, which may round otherwise."""
    def opens(k: int) -> bool:
        return v[k] - anchor > width or (not strict and v[k] - anchor == width)

    j = i + int(np.searchsorted(v[i:n], anchor + width, "right" if strict else "left"))
    while j > i and opens(j - 1):
        j -= 1
    while j < n and not opens(j):
        j += 1
    return j


def _marker(keys: list[str], value: str, width, strict: bool, inherited: str | None, starts_only: bool = False):
    """mapInArrow function that appends the anchor value of each row, or keeps the first row of
    each window only."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = _key_breaks(batch, keys, last)
            v = batch.column(value).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(new).tolist()
            edges = ([] if edges and edges[0] == 0 else [0]) + edges
            out, starts = np.empty(len(v), v.dtype), []
            for a, b in zip(edges, [*edges[1:], len(v)]):
                if new[a]:
                    given = batch.column(inherited)[a].as_py() if inherited else None
                    anchor = v[a] if given is None else np.frombuffer(given, v.dtype)[0]
                    starts.append(a)
                # One jump for each window.
                i = a
                while i < b:
                    j = _next_start(v, i, b, anchor, width, strict)
                    out[i:j] = anchor
                    if j < b:
                        anchor = v[j]
                        if not (j == a and new[a]):
                            starts.append(j)
                    i = j
            arrays = [c for name, c in zip(batch.schema.names, batch.columns) if name != inherited]
            names = [name for name in batch.schema.names if name != inherited]
            arrays.append(pa.array(out, type=batch.column(value).type))
            marked = pa.RecordBatch.from_arrays(arrays, names=[*names, "__anchor"])
            yield marked.take(pa.array(starts, pa.int64())) if starts_only else marked

    return mark


class ExitMaps:
    """A slice's function: the entries that may be its first anchor, in order, and the anchor that each of them leads to. The first
    entry that opens a window after the inherited anchor counts; if none does, that anchor lasts on."""

    def __init__(self, dtype, width, strict: bool):
        self.dtype, self.width, self.strict = np.dtype(dtype), width, strict

    def pack(self, entries: np.ndarray, exits: np.ndarray) -> bytes:
        # Of neighbours with the same exit the last one answers for all.
        keep = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, bool)
        return np.concatenate([entries[keep], exits[keep]]).astype(self.dtype).tobytes()

    def unpack(self, summary: bytes) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(summary, self.dtype)
        return both[:len(both) // 2], both[len(both) // 2:]

    def of(self, v: np.ndarray) -> bytes:
        """The function of a slice with values ``v``."""
        n = len(v)
        # A row never follows itself, also where windows have no width.
        nxt = np.maximum(np.searchsorted(v, v + self.width, "right" if self.strict else "left"), np.arange(n) + 1)
        last = list(range(n))
        for i in range(n - 1, -1, -1):
            j = int(nxt[i])
            if j < n:
                last[i] = last[j]
        # Later rows lie beyond a window that began before the slice.
        reach = min(n, int(np.searchsorted(v, v[0] + self.width, "right")) + 1)
        return self.pack(v[:reach], v[np.asarray(last[:reach])])

    def leave(self, anchor, summary: bytes):
        """The anchor after the slice; without an inherited one the slice's first row is one."""
        entries, exits = self.unpack(summary)
        if anchor is None:
            return exits[0]
        i = _next_start(entries, 0, len(entries), anchor, self.width, self.strict)
        return exits[i] if i < len(entries) else anchor

    def apply(self, state: bytes | None, summary: bytes) -> bytes:
        anchor = None if state is None else np.frombuffer(state, self.dtype)[0]
        return np.array([self.leave(anchor, summary)], self.dtype).tobytes()

    def combine(self, a: bytes, b: bytes) -> bytes:
        entries, exits = self.unpack(a)
        exits = np.array([self.leave(x, b) for x in exits], self.dtype)
        # An anchor that outlasts the first slice may be followed in the second one.
        more, beyond = self.unpack(b)
        reach = min(len(more), int(np.searchsorted(more, entries[0] + self.width, "right")) + 1)
        return self.pack(np.concatenate([entries, more[:reach]]), np.concatenate([exits, beyond[:reach]]))


def _summaries(keys: list[str], value: str, maps: ExitMaps):
    """mapInArrow function: the function of each key's rows in a slice."""

    def one(seg: pa.RecordBatch) -> pa.RecordBatch:
        cols = [pa.array([seg.column(k)[0].as_py()], type=seg.schema.field(k).type) for k in keys]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array([seg.column(_SLICE)[0].as_py()], pa.int32()), pa.array([maps.of(seg.column(value).to_numpy())], pa.binary())],
            names=[*keys, _SLICE, "summary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One slice is one bounded partition; its narrow rows are held as arrays.
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new, _ = _key_breaks(batch, keys, None)
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield one(batch.slice(a, b - a))

    return run


def _with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def mark_anchors(runs: Runs, value: str, width, out: str, strict: bool = False) -> Runs:
    """Add ``out``: the anchor value of each row. ``value`` must order the rows like ``ts``.

    ``strict`` starts a window at a gap above ``width`` instead of at or above it.
    """
    df, keys = runs.rows, runs.keys
    kind = df.schema[value].dataType
    if not runs.cut:
        # Only key, order and value visit Python, and only the rows that start a window come back.
        # They are laid among the full rows, which move once and see the latest start before them.
        lean = df.select(*dict.fromkeys([*keys, runs.ts, runs.id, value]))
        lean = (lean.repartition(*keys) if keys else lean.repartition(1)).sortWithinPartitions(*keys, runs.ts, runs.id)
        schema = _with_fields(lean.schema, T.StructField("__anchor", kind))
        starts = lean.mapInArrow(_marker(keys, value, width, strict, None, starts_only=True), schema)
        starts = starts.select(*dict.fromkeys([*keys, runs.ts, runs.id]), "__anchor", F.lit(0).alias("__row"))
        mixed = df.withColumn("__row", F.lit(1)).unionByName(starts, allowMissingColumns=True)
        before = (Window.partitionBy(*keys).orderBy(runs.ts, runs.id, "__row")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        runs.rows = (mixed.withColumn(out, F.last("__anchor", ignorenulls=True).over(before))
                     .filter("__row = 1").drop("__row", "__anchor"))
        return runs

    across = Window.partitionBy(*keys)
    cut = (df.groupBy(_SLICE, *keys).agg(F.lit(1).alias("__one"))
           .withColumn("__n", F.count(F.lit(1)).over(across)).filter("__n > 1").drop("__n"))
    cut_rows = null_safe_join(df.select(_SLICE, *keys, value), stored(cut), keys, "inner", ["__one"])
    maps = ExitMaps(pa.RecordBatch.from_arrays([pa.array([], to_arrow_type(kind))], ["v"]).column(0).to_numpy(zero_copy_only=False).dtype, width, strict)
    summary_schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(_SLICE, T.IntegerType()), T.StructField("summary", T.BinaryType())])
    carry = carried(cut_rows.mapInArrow(_summaries(keys, value, maps), summary_schema), keys, _SLICE, runs.slices, maps.combine, maps.apply)
    rows = null_safe_join(df, carry, keys, "left", ["carry"]).withColumnRenamed("carry", "__carry")
    schema = _with_fields(df.schema, T.StructField("__anchor", kind))
    runs.rows = rows.mapInArrow(_marker(keys, value, width, strict, "__carry"), schema) \
        .withColumnRenamed("__anchor", out)
    return runs


def null_safe_join(rows: DataFrame, small: DataFrame, keys: list[str], how: str, keep: list[str]) -> DataFrame:
    """Map-side join on slice and keys: ``small`` has at most one row per slice and cut key."""
    s = small.select(F.col(_SLICE).alias("__s"), *keep, *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    cond = F.col(_SLICE) == F.col("__s")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(F.broadcast(s), cond, how).drop("__s", *[f"__k{i}" for i in range(len(keys))])
