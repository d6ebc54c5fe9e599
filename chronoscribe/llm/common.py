"""Shared helpers: pieces of Arrow batches, words, and hashes of any span of a piece.

Texts are handled as UTF-8 bytes of an Arrow string column, a bounded piece at a time, with numpy. A
text longer than the piece size is a piece of its own; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe.session import durable, stored

#: Bytes of text that are worked on at a time.
PIECE = 1 << 20

#: Hashes of spans are polynomials over two fields of this size, at two fixed points each chosen at random.
_P = np.uint64((1 << 31) - 1)
_RANDOM = np.random.Generator(np.random.PCG64(20240101))
_POINTS = [int(x) for x in _RANDOM.integers(1 << 20, int(_P) - 1, 2)]
_TABLES = [_RANDOM.integers(1, int(_P), 256, dtype=np.uint64) for _ in _POINTS]
_POWERS = [[np.ones(1, np.uint32), np.ones(1, np.uint32)] for _ in _POINTS]


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainder of 64-bit numbers by ``_P``."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return x - _P * (x >= _P)


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of point ``k``, and of its inverse."""
    for which, x in enumerate((_POINTS[k], pow(_POINTS[k], -1, int(_P)))):
        have = _POWERS[k][which]
        while len(have) < n:
            step = np.uint64(pow(x, len(have), int(_P)))
            have = np.concatenate([have, _mod(have.astype(np.uint64) * step).astype(np.uint32)])
        _POWERS[k][which] = have
    return _POWERS[k][0][:n], _POWERS[k][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a one-to-one map)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Spans:
    """64-bit hashes of any span of a sequence of symbols, from running sums.

    Equal spans have equal hashes wherever they stand. A span of n symbols is a polynomial of degree below n over two fields of 2**31 - 1
    elements; two given spans of equal length have equal hashes by chance only, at odds of at most (n / 2**31)**2 over the choice of
    the two points."""

    def __init__(self, symbols: np.ndarray):
        self.sums, self.back = [], []
        for k in range(len(_POINTS)):
            values = _TABLES[k][symbols] if symbols.dtype == np.uint8 else _mod(mix(symbols) if k else symbols)
            p, back = _powers(k, len(values) + 1)
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(_mod(values * p[:-1]), out=sums[1:])
            self.sums.append(sums)
            self.back.append(back)

    @staticmethod
    def _both(parts: list[np.ndarray], length) -> np.ndarray:
        return mix((parts[0] << np.uint64(32) | parts[1]) ^ mix(np.asarray(length, np.uint64)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._both([_mod(_mod(s[ends] - s[starts]) * b[starts]) for s, b in zip(self.sums, self.back)], ends - starts)

    def grams(self, n: int) -> np.ndarray:
        """The hash of the ``n`` symbols from each position that has as many."""
        if len(self.sums[0]) <= n:
            return np.zeros(0, np.uint64)
        return self._both([_mod(_mod(s[n:] - s[:-n]) * b[:len(s) - n]) for s, b in zip(self.sums, self.back)], np.array([n]))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an Arrow string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8, off[-1]) if buffers[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data[off[0]:], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``limit`` bytes in column ``text``, or of one row."""
    for batch in batches:
        _, off = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def blank(data: np.ndarray) -> np.ndarray:
    """Bytes \\x20 and \\x09-\\x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of true positions within a text."""
    first = np.zeros(len(inside) + 1, bool)
    first[off[:-1]] = True
    first[-1] = True
    before = np.empty(len(inside), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: its value occurs again somewhere, and it occurred at an earlier place."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, earlier


def within(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made to differ between texts."""
    return mix(hashes + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column; a null is an empty text."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks, from ``name``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_struct(df: DataFrame, text: str, name: str, fields: str, fn) -> DataFrame:
    """``df`` with a struct column ``name``: ``fn`` gets (bytes, offsets) of a piece and returns arrays in the
    order of ``fields``. All columns of ``df`` pass through."""
    whole = fresh(df, "whole_text")
    wide = df.withColumn(whole, text_of(df, text))
    kind = T._parse_datatype_string(fields)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    names = df.columns

    def run(batches):
        for piece in pieces(batches, whole):
            arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in fn(*raw(column(piece, whole)))]
            struct = pa.StructArray.from_arrays(arrays, [f.name for f in kind.fields])
            yield pa.RecordBatch.from_arrays([*piece.columns[:len(names)], struct], [*names, name])

    return wide.mapInArrow(run, schema)


def bounded(spark: SparkSession) -> None:
    """Let Spark hand texts to Python workers in batches of a few MB instead of ten thousand rows. The registered
    queries and the pipeline's stages set this for their session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: a job of its own, no lineage."""
    return stored(df)


__all__ = ["cut", "durable", "stored"]
