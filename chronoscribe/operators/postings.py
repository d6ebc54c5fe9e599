"""Packed postings: one row for each term that a row of a table has.

The positions of a term stand in one binary, as the gaps between them in variable-length numbers of seven bits a byte. Positions run
through all fields of the row, with one place left free between fields, so that no phrase spans two of them.

Lists hold many such rows of one term: the ids as an array, the numbers of each column and the places of all rows in one binary each. They are what is
written, since a value costs Spark more than the bytes that it holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe.functions.text import raw_tokens

#: Tokens that are packed at a time, and the bytes of text that are taken for one.
TOKENS, BYTES_A_TOKEN = 1 << 20, 4
#: Bytes of text over ``BYTES_A_TOKEN`` that are packed into lists at a time (more give longer lists but leave the caches), and the rows that a list has at most.
LIST_TOKENS, LIST = 2 * TOKENS, 1024


def gaps_to_bytes(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of all numbers, and how many each takes."""
    gaps = gaps.astype(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1) << np.uint64(7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0)
        out[start[has] + k] = ((gaps[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out, size


def bytes_to_gaps(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64), ends
    start = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, ends - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start), ends


@F.pandas_udf(T.ArrayType(T.LongType()))
def positions(at: pd.Series) -> pd.Series:
    """Positions of packed postings, in order."""
    blobs = at.tolist()
    gaps, ends = bytes_to_gaps(np.frombuffer(b"".join(blobs), np.uint8))
    edges = np.searchsorted(ends, np.cumsum([0, *map(len, blobs)]))
    total = np.concatenate([[0], np.cumsum(gaps)])
    return pd.Series([total[a + 1:b + 1] - total[a] for a, b in zip(edges[:-1], edges[1:])])


@F.pandas_udf(T.ArrayType(T.LongType()))
def numbers(packed: pd.Series) -> pd.Series:
    """Packed numbers as they are."""
    blobs = packed.tolist()
    values, ends = bytes_to_gaps(np.frombuffer(b"".join(blobs), np.uint8))
    edges = np.searchsorted(ends, np.cumsum([0, *map(len, blobs)]))
    return pd.Series([values[a:b] for a, b in zip(edges[:-1], edges[1:])])


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def split_places(at: pd.Series, tf: pd.Series) -> pd.Series:
    """The packed places of each row of a list, from those of all its rows and the packed numbers of them."""
    blobs = at.tolist()
    ends = np.flatnonzero(np.frombuffer(b"".join(blobs), np.uint8) < 128) + 1
    out, seen, begun = [], 0, 0
    for blob, packed in zip(blobs, tf.tolist()):
        last = seen + np.cumsum(bytes_to_gaps(np.frombuffer(packed, np.uint8))[0])
        cut = [0, *(ends[last - 1] - begun).tolist()]
        out.append([blob[a:b] for a, b in zip(cut, cut[1:])])
        seen, begun = int(last[-1]), begun + len(blob)
    return pd.Series(out)


def _letters() -> np.ndarray:
    """Which code points below ``_KNOWN`` are letters or numbers; there are no combining marks among them."""
    return np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(_KNOWN)])


#: Texts of code points below this one are cut by a table; in UTF-8 they take two bytes at most.
_KNOWN = 0x240
_WORD = _letters()
_ASCII = np.concatenate([_WORD[:128], np.zeros(128, bool)])


def _edges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of lower-cased texts below ``_KNOWN``, and the first byte of each token and of what follows it."""
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    blob = texts.buffers()[2]
    data = np.frombuffer(blob, np.uint8)[:off[-1]] if blob is not None else np.zeros(0, np.uint8)
    word = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    word[lead] = _WORD[((data[lead] & 31).astype(np.int64) << 6) | (data[lead + 1] & 63)] if len(lead) else False
    word[lead + 1] = word[lead]
    word[:off[0]] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    return off, start, np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of such texts: the row of each, its place in the row, and itself."""
    off, start, end = _edges(texts)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    # Tokens and what lies between them; every second piece is a token.
    pieces = pa.StringArray.from_buffers(2 * len(start) - 1, pa.py_buffer(np.stack([start, end], 1).astype(np.int32)), texts.buffers()[2])
    rows = np.searchsorted(off, start, "right") - 1
    count = np.bincount(rows, minlength=len(texts))
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count), pieces.take(pa.array(np.arange(0, len(pieces), 2)))


def _listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same from token arrays."""
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count), lists.flatten().cast(pa.string())


def _count(batch: pa.RecordBatch, fields: int) -> pa.Array:
    """Tokens of each row."""
    length = np.zeros(batch.num_rows, np.int64)
    for i in range(fields):
        off, start, _ = _edges(batch.column(1 + 2 * i).fill_null(""))
        length += np.diff(np.searchsorted(start, off)) + pc.fill_null(pc.list_value_length(batch.column(2 + 2 * i)), 0).to_numpy(zero_copy_only=False)
    return pa.array(length, pa.int32())


def _lengths(batch: pa.RecordBatch, fields: int) -> pa.RecordBatch:
    """The lines without a term: nothing but the tokens of a row is counted."""
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([batch.column(0), _count(batch, fields), pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int64), pa.int32()),
                                       pa.nulls(n, pa.binary())], ["id", "len", "term", "tf", "at"])


def _found(batch: pa.RecordBatch, fields: int, stem: Callable[[pa.Array], pa.Array] | None, deal) -> tuple:
    """Postings of a batch (id, text and token array of each field): length of each row; row, term number, count of each posting and
    its packed places; the terms; the group of each row. Postings are sorted by group, term and the order of the rows, both given by
    ``deal`` from the batch and the lengths; without it by term and row, terms as they come."""
    n = batch.num_rows
    found, free = [], np.zeros(n, np.int64)
    for i in range(fields):
        # A row has a text or an array.
        parts = [_cut(batch.column(1 + 2 * i).fill_null("")), _listed(batch.column(2 + 2 * i))]
        found += [(r, p + free[r], w) for r, p, w in parts]
        free = free + sum(np.bincount(r, minlength=n) for r, _, _ in parts) + 1
    length = free - fields
    rows, place = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    words = pa.concat_arrays([w for _, _, w in found]).dictionary_encode()
    code, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    if stem is not None:
        stems = stem(known).dictionary_encode()
        code, known = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code], stems.dictionary
    group, rank = np.zeros(n, np.int64), np.arange(n)
    if deal is not None:
        by = pc.array_sort_indices(known)
        known, number = known.take(by), np.empty(len(known), np.int64)
        number[by.to_numpy(zero_copy_only=False)] = np.arange(len(known))
        code = number[code]
        group, order = deal(batch, length)
        rank[order] = np.arange(n)
    # Places of a row come in order, so a stable sort keeps them. Rows of one term stand together.
    order = np.argsort((group[rows] * max(1, len(known)) + code) * n + rank[rows], kind="stable")
    rows, code, place = rows[order], code[order], place[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (code[1:] != code[:-1])
    head = np.flatnonzero(new)
    gaps = place.copy()
    gaps[1:] -= np.where(new[1:], 0, place[:-1])
    data, size = gaps_to_bytes(gaps)
    tf = np.diff(np.append(head, len(rows)))
    edges = np.concatenate([[0], np.cumsum(np.add.reduceat(size, head) if len(head) else np.zeros(0, np.int64))])
    at = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return length, rows[head], code[head], tf, at, known, group


def _pack(batch: pa.RecordBatch, fields: int, stem: Callable[[pa.Array], pa.Array] | None) -> pa.RecordBatch:
    """Packed rows of a batch; each row of the batch also gives one without a term."""
    n = batch.num_rows
    length, rows, code, tf, at, known, _ = _found(batch, fields, stem, None)
    own = np.concatenate([np.arange(n), rows])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(own)), pa.array(length[own], pa.int32()), pa.concat_arrays([pa.nulls(n, pa.string()), known.take(pa.array(code))]),
         pa.array(np.concatenate([np.zeros(n, np.int64), tf]), pa.int32()), pa.concat_arrays([pa.nulls(n, pa.binary()), at])],
        ["id", "len", "term", "tf", "at"])


def _pack_dealt(batch: pa.RecordBatch, fields: int, stem: Callable[[pa.Array], pa.Array] | None, deal) -> pa.RecordBatch:
    """Packed rows of a batch by group, each with its group."""
    length, rows, code, tf, at, known, group = _found(batch, fields, stem, deal)
    return pa.RecordBatch.from_arrays(
        [pa.array(group[rows], pa.int32()), batch.column(0).take(pa.array(rows)), pa.array(length[rows], pa.int32()), known.take(pa.array(code)), pa.array(tf, pa.int32()), at],
        ["writer", "id", "len", "term", "tf", "at"])


def _texts(docs: DataFrame, id: str, fields: list[str | Column], *more: Column) -> DataFrame:
    """What is packed: the id, each field as a text or as an array of tokens, and ``more``. Texts that stay below ``_KNOWN`` when lower-cased
    travel as they are and are cut beside the packing; the others are cut by the expression of ``raw_tokens``."""
    columns = []
    for i, field in enumerate(fields):
        c = F.coalesce(F.col(field) if isinstance(field, str) else field, F.lit(""))
        unknown = F.lower(c).rlike(f"[^\\x00-\\x{{{_KNOWN - 1:x}}}]")
        columns += [F.when(~unknown, F.lower(c)).alias(f"x{i}"), F.when(unknown, raw_tokens(c)).alias(f"t{i}")]
    return docs.select(F.col(id).alias("id"), *columns, *more)


def _by_tokens(n: int, made: Callable[[pa.RecordBatch], pa.RecordBatch], tokens: int = TOKENS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``made`` of batches of ``n`` fields, some ``tokens`` at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = sum(pc.fill_null(pc.binary_length(batch.column(1 + 2 * i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n))
            lists = sum(pc.fill_null(pc.list_value_length(batch.column(2 + 2 * i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n))
            upto = np.cumsum(np.concatenate([[0], texts // BYTES_A_TOKEN + lists]))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + tokens, "right")) - 1)
                # A slice of a column keeps its offsets into the whole.
                yield made(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, to - at).columns], batch.schema.names))
                at = to

    return run


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("len", T.IntegerType()), T.StructField("term", T.StringType()),
                         T.StructField("tf", T.IntegerType()), T.StructField("at", T.BinaryType())])


def pack(docs: DataFrame, id: str, fields: list[str | Column], stem: Callable[[pa.Array], pa.Array] | None = None, places: bool = True) -> DataFrame:
    """``(id, len, term, tf, at)``: ``tf`` places of ``term`` in a row of ``len`` tokens. Each row also has one line whose term is
    null; without ``places`` it has this line only. A map-only job. ``stem`` gets the distinct tokens of a batch."""
    rows, n = _texts(docs, id, fields), len(fields)
    return rows.mapInArrow(_by_tokens(n, lambda b: _pack(b, n, stem) if places else _lengths(b, n)), _schema(rows))


def pack_dealt(docs: DataFrame, id: str, fields: list[str | Column], stem: Callable[[pa.Array], pa.Array] | None,
               levels: list[tuple[int, int]], writers: int) -> DataFrame:
    """``(writer, id, len, term, tf, at)``: the postings of ``pack``, sorted within each batch by writer, term and block, so that a writer
    merges what it gets. ``levels`` has the greatest length of each level of lengths, ascending, and the number of its blocks. The rows
    of a block have one writer."""
    rows, n = _texts(docs, id, fields, F.xxhash64(F.col(id)).alias("hash")), len(fields)
    most, blocks = (np.array([x[k] for x in levels], np.int64) for k in (0, 1))
    first = np.cumsum(blocks) - blocks

    def deal(batch: pa.RecordBatch, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = np.minimum(np.searchsorted(most, length), len(most) - 1)
        part = np.mod(batch.column(1 + 2 * n).to_numpy(zero_copy_only=False), blocks[level])
        return (first[level] + part) % writers, np.lexsort((np.arange(len(length)), part, level))

    schema = T.StructType([T.StructField("writer", T.IntegerType()), *_schema(rows)])
    return rows.mapInArrow(_by_tokens(n, lambda b: _pack_dealt(b, n, stem, deal)), schema)


def counted(docs: DataFrame, id: str, fields: list[str | Column]) -> DataFrame:
    """Rows as ``pack_lists`` takes them: what is packed (``_texts``), and ``len``. A map-only job."""
    rows, n = _texts(docs, id, fields), len(fields)
    made = lambda b: pa.RecordBatch.from_arrays([*b.columns, _count(b, n)], [*b.schema.names, "len"])
    return rows.mapInArrow(_by_tokens(n, made), T.StructType([*rows.schema, T.StructField("len", T.IntegerType())]))


def _bytes(packed: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where each binary begins, the end of the last, and what they lie in."""
    return np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1], packed.buffers()[2]


def _runs(code: np.ndarray, terms: pa.Array, columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    """Lists: one row for each run of equal numbers of ``terms``, or more where it is longer than ``LIST``, and its length ``n``. Blocks ascend in a
    run and are packed as gaps, other numbers as they are."""
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    run = np.flatnonzero(new)
    head = np.flatnonzero((np.arange(len(code)) - np.repeat(run, np.diff(np.append(run, len(code))))) % LIST == 0)
    off = np.append(head, len(code))
    made = [terms.take(pa.array(code[head])), pa.array(np.diff(off), pa.int32())]
    for name, c in columns.items():
        if name == "id":
            made.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), c))
            continue
        if name == "at":
            edges, data = _bytes(c)
        else:
            if name == "block":
                c = np.diff(c, prepend=0)
                c[head] = columns[name][head]
            data, size = gaps_to_bytes(c)
            edges, data = np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.py_buffer(data)
        made.append(pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(edges[off]), data]))
    return pa.RecordBatch.from_arrays(made, ["term", "n", *columns])


def _as_lists(id: T.DataType) -> T.StructType:
    kinds = {"term": T.StringType(), "n": T.IntegerType(), "block": T.BinaryType(), "id": T.ArrayType(id), "len": T.BinaryType(), "tf": T.BinaryType(), "at": T.BinaryType()}
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


def pack_lists(rows: DataFrame, fields: int, stem: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """``(term, n, block, id, len, tf, at)``: the postings of rows of ``counted`` and their ``block``, as lists. Rows stay in their order. A map-only job."""
    as_it_is = lambda batch, length: (np.zeros(batch.num_rows, np.int64), np.arange(batch.num_rows))

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, own, code, tf, at, known, _ = _found(batch, fields, stem, as_it_is)
        block = batch.column(2 + 2 * fields).to_numpy(zero_copy_only=False)
        return _runs(code, known, {"block": block[own], "id": batch.column(0).take(pa.array(own)), "len": length[own], "tf": tf, "at": at})

    wanted = rows.select("id", *[f"{x}{i}" for i in range(fields) for x in "xt"], "len", "block")
    return wanted.mapInArrow(_by_tokens(fields, made, LIST_TOKENS), _as_lists(rows.schema["id"].dataType))


def listed(rows: DataFrame) -> DataFrame:
    """Postings of one row each, sorted by term and block, as such lists. A map-only job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).dictionary_encode()
            block, length, tf = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3, 4))
            yield _runs(words.indices.to_numpy(zero_copy_only=False), words.dictionary, {"block": block, "id": batch.column(2), "len": length, "tf": tf, "at": batch.column(5)})

    return rows.select("term", "block", "id", "len", "tf", "at").mapInArrow(run, _as_lists(rows.schema["id"].dataType))


def unlisted(lists: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each element of lists: ``columns`` and their types, ``term`` and ``bucket``. What is not asked for is not read."""
    unpacked = {"id": F.col("id"), "block": positions("block"), "at": split_places("at", "tf")}
    rows = lists.select("term", "bucket", "n", *[unpacked.get(c, numbers(c)).alias(c) for c in columns])
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(*[F.get(c, F.col("__i")).cast(t).alias(c) for c, t in columns.items()], "term", "bucket")


def _best_counts(code: np.ndarray, block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term, block and ``tf``, in this order: where its row of the least length stands, and the number of its rows."""
    order = np.lexsort((length, tf, block, code))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in (code, block, tf)], axis=0)
    head = np.flatnonzero(new)
    return order[head], np.diff(np.append(head, len(order)))


def tops(rows: DataFrame) -> DataFrame:
    """``(term, block, tf, rows, len)`` of postings ``(term, block, tf, len)``: how many rows of a block have a term
    ``tf`` times, and the least length of such a row. No row of the block weighs more than the best of these.

    A map-only job: rows that are read apart are counted apart, and who reads the result adds them up. Postings that are sorted by
    term and block, as files of an index are, give few such parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).dictionary_encode()
            block, tf, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            at, n = _best_counts(words.indices.to_numpy(zero_copy_only=False), block, tf, length)
            first = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*first.columns[:3], pa.array(n, pa.int64()), first.column(3)], ["term", "block", "tf", "rows", "len"])

    return rows.mapInArrow(run, "term string, block long, tf int, rows long, len int")


def tops_listed(lists: DataFrame) -> DataFrame:
    """``tops`` of lists, as lists ``(term, n, block, tf, rows, len)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + TOKENS, "right")) - 1)
                part, n = batch.slice(at, to - at), np.diff(upto[at:to + 1])
                words = part.column(0).dictionary_encode()
                code = np.repeat(words.indices.to_numpy(zero_copy_only=False), n)
                edges = [_bytes(part.column(i)) for i in (2, 3, 4)]
                gaps, tf, length = (bytes_to_gaps(np.frombuffer(data, np.uint8)[e[0]:e[-1]])[0] for e, data in edges)
                total, first = np.cumsum(gaps), upto[at:to] - upto[at]
                block = total - np.repeat(total[first] - gaps[first], n)
                own, rows = _best_counts(code, block, tf, length)
                yield _runs(code[own], words.dictionary, {"block": block[own], "tf": tf[own], "rows": rows, "len": length[own]})
                at = to

    return lists.select("term", "n", "block", "tf", "len").mapInArrow(run, "term string, n int, block binary, tf binary, rows binary, len binary")
