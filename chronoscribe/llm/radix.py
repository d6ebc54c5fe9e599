"""Repeated 50-byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only through ``DEPTH`` bytes, digit by digit, and a group that one document has to
itself leaves the sort after the digit that shows it:

1. A suffix's first digit is an anchor: of the ``GRAM``-byte strings within its ``DEPTH`` bytes, the one with the
   least hash. Equal strings of ``DEPTH`` bytes have equal anchors at equal places. Neighbouring suffixes share
   an anchor, so what is dealt out by Spark is one digit for each anchor, a sixteenth of all suffixes. The answer is a
   bit: anchors that one document has to itself go no further.
2. The second digit is all bytes that the suffixes of one anchor cover together. Where an earlier document has
   the same ones, all of them are repeats; so a long copy is settled here, entry by entry.
3. What is left are anchors that stand in different surroundings, mostly at the edges of copies. Their suffixes begin
   in the farther or in the nearer half of the places before the anchor; the third digit is the bytes that all suffixes of a half
   have in common, and a bit says whether other documents have them.
4. The suffixes of shared halves get the last digit one by one, all ``DEPTH`` bytes; the equal groups are the repeated windows.

Digits that settle something (2 and 4) are whole 64-bit hashes, in what is dealt out too. Where only a bit is asked (1 and 3), 40 bits
of the digit travel besides those that choose its part: a chance match there leaves an entry in the sort and decides nothing. Shuffle
files go with the job that wrote them. Texts are kept in compressed blocks in the shared folder; entries that repeat within a block
leave it as one, so a passage that all documents share gives one entry for each block, not for each document.

Defined cases: a null text is an empty one; a null document id is larger than all others; equal ids are not smaller
than each other, so rows of one id keep what they share; texts below ``DEPTH`` bytes keep everything; texts of any length are
whole in one block; an empty table gives no rows; columns not named in ``keep`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common
from chronoscribe.session import tidy

DEPTH, GRAM = 50, 20
WIDTH = DEPTH - GRAM + 1
#: Bytes of text in a block, of those that are worked on at a time, and for each part that entries are dealt to.
BLOCK, STEP, PART = 4 << 20, 1 << 20, 64 << 20
LEAST_PARTS = 64
REPEAT, OPEN, ANSWER = 0, 1, 2
#: Suffixes begin at most so many bytes before their anchor: those of the nearer half, and of the farther one.
HALVES = (0, WIDTH // 2), (WIDTH // 2 + 1, WIDTH - 1)
_LAST = (1 << 63) - 1


def _packed(**columns: np.ndarray) -> bytes:
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _cut(df: DataFrame) -> DataFrame:
    with tidy(df.sparkSession):
        return common.cut(df)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: the hash of its string, the hash of all bytes of its suffixes, its text, the place of its first
    suffix in the text, and how many more follow."""
    return _anchored(data, off)[:5]


def _anchored(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """``anchors``, and how far the anchor's string stands from the first suffix."""
    none = np.zeros(0, np.uint64)
    if len(data) < DEPTH:
        return none, none, *[np.zeros(0, np.int64)] * 4
    spans = common.Spans(data)
    h = spans.grams(GRAM)
    place = np.uint64(0xFFFFFFFF)
    least = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= WIDTH:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if WIDTH > reach:
        least = np.minimum(least[:len(least) - (WIDTH - reach)], least[WIDTH - reach:])
    at = (least & place).astype(np.int64)
    size = np.diff(off)
    last = np.repeat(off[1:], size)[:len(at)]
    start = np.flatnonzero(np.arange(len(at)) + DEPTH <= last)
    if not len(start):
        return none, none, *[np.zeros(0, np.int64)] * 4
    a = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(start)) - 1
    low, high = start[first], start[end]
    text = np.searchsorted(off, low, "right") - 1
    return h[a[first]], spans.of(low, high + DEPTH), text, low - off[text], high - low, a[first] - low


def _by_block(block: np.ndarray, kind: int, text: np.ndarray, low: np.ndarray, more: np.ndarray, ahead: np.ndarray | None = None):
    """Rows (block, kind, entries) from entries of several blocks."""
    order = np.lexsort((low, text, block))
    block, text, low, more = block[order], text[order], low[order], more[order]
    ahead = np.zeros(len(block)) if ahead is None else ahead[order]
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
    for i, e in zip(edges, [*edges[1:], len(block)]):
        yield int(block[i]), kind, _packed(text=text[i:e].astype(np.int32), low=low[i:e].astype(np.int32), more=more[i:e].astype(np.uint8),
                                          ahead=ahead[i:e].astype(np.uint8))


_ROWS = "part int, block bigint, kind int, entries binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _distinct(digit: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """The order of ``digit`` by value, where each value begins in it, the part of each value, the order in which values are
    dealt (by part, then by their first place), and for each entry the place of its value in that order."""
    order = np.argsort(digit, kind="stable")
    new = np.append(True, digit[order[1:]] != digit[order[:-1]])
    first = np.flatnonzero(new)
    part = (digit[order[first]] >> np.uint64(48)).astype(np.int64) % parts
    dealt = np.lexsort((order[first], part))
    place = np.empty(len(dealt), np.int64)
    place[dealt] = np.arange(len(dealt))
    of = np.empty(len(digit), np.int64)
    of[order] = place[np.cumsum(new) - 1]
    return order, first, part, dealt, of


def _asked(block: int, parts: int, digit: np.ndarray, own: np.ndarray) -> list[tuple]:
    """Rows (part, block, kind, entries) with the distinct digits of a block: 40 bits of each, the least order of a document that has
    it, and whether others of the block have it. A value leaves the block once."""
    if not len(digit):
        return []
    order, first, part, dealt, _ = _distinct(digit, parts)
    least, most = np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)
    value, several = digit[order[first]], least != most
    edges, rows = np.searchsorted(part[dealt], np.arange(parts + 1)), []
    for p in range(parts):
        o = dealt[edges[p]:edges[p + 1]]
        if len(o):
            rows.append((p, block, OPEN, b"".join([
                np.array([len(o)], "<u4").tobytes(), value[o].astype("<u4").tobytes(), (value[o] >> np.uint64(32)).astype(np.uint8).tobytes(),
                np.packbits(several[o]).tobytes(), pa.Codec("zstd").compress(least[o].astype("<i8").tobytes(), asbytes=True)])))
    return rows


def _answer(table: pa.Table) -> pa.Table:
    """For one part: which digits documents of different orders have; a row (block, kind, entries) for each row, in its order."""
    parts_of, digit, own, several, size = table.column("part").to_pylist(), [], [], [], []
    for blob in table.column("entries").to_pylist():
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        digit.append(np.frombuffer(blob, "<u4", n, 4).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 + 4 * n).astype(np.uint64) << np.uint64(32))
        bits = -(-n // 8)
        several.append(np.unpackbits(np.frombuffer(blob, np.uint8, bits, 4 + 5 * n), count=n).astype(bool))
        own.append(np.frombuffer(pa.Codec("zstd").decompress(blob[4 + 5 * n + bits:], decompressed_size=8 * n, asbytes=True), "<i8"))
        size.append(n)
    digit, own, several = np.concatenate(digit), np.concatenate(own), np.concatenate(several)
    order = np.argsort(digit, kind="stable")
    new = np.append(True, digit[order[1:]] != digit[order[:-1]])
    first = np.flatnonzero(new)
    own = own[order]
    shared = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | np.logical_or.reduceat(several[order], first)
    flag = np.empty(len(digit), bool)
    flag[order] = shared[np.cumsum(new) - 1]
    ends = np.cumsum(size)
    rows = [(b, ANSWER, np.array([p], "<u4").tobytes() + np.packbits(flag[e - n:e]).tobytes())
            for b, p, n, e in zip(table.column("block").to_pylist(), parts_of, size, ends)]
    return pa.Table.from_batches([_batch(rows, _NAMES[1:], _KINDS[1:])])


def _told(blobs: list[bytes], parts: int, digit: np.ndarray) -> np.ndarray:
    """For each entry: other documents have its digit, from the answers to ``_asked``."""
    if not len(digit):
        return np.zeros(0, bool)
    _, _, part, _, of = _distinct(digit, parts)
    answers = {int(np.frombuffer(b, "<u4", 1)[0]): b for b in blobs}
    count = np.bincount(part, minlength=parts)
    return np.concatenate([np.unpackbits(np.frombuffer(answers[p], np.uint8, offset=4), count=count[p]) for p in np.flatnonzero(count).tolist()]).astype(bool)[of]


def _halves(text, low, more, ahead, at) -> tuple[np.ndarray, ...]:
    """For each half that an entry has suffixes of: the entry, its first suffix and its last one (from the entry's first), and the
    bytes that all suffixes of the half have in common, from and to. ``at``: where the texts of the entries begin."""
    out = []
    for near, far in HALVES:
        first, last = np.maximum(0, ahead - far), np.minimum(more, ahead - near)
        of = np.flatnonzero(first <= last)
        anchor = (at + low + ahead)[of]
        out.append((of, first[of], last[of], anchor - near, anchor - far + DEPTH))
    return tuple(map(np.concatenate, zip(*out)))


def _dealt(block: int, parts: int, gram, cover, own, text, low, more, ahead) -> list[tuple]:
    """Rows (part, block, kind, entries) of one block's entries, by the high bits of ``gram``. Of equal ones only those of the
    block's first document leave it; the others are repeats already and go to parts from ``parts`` on."""
    order = np.lexsort((own, cover, gram))
    gram, cover, own, text, low, more, ahead = (x[order] for x in (gram, cover, own, text, low, more, ahead))
    new = np.append(True, (gram[1:] != gram[:-1]) | (cover[1:] != cover[:-1])) if len(gram) else np.zeros(0, bool)
    later = own > own[np.flatnonzero(new)][np.cumsum(new) - 1] if len(own) else new
    rows = [(parts + block % parts, *r) for r in _by_block(np.full(int(later.sum()), block), REPEAT, text[later], low[later], more[later])]
    gram, cover, own, text, low, more, ahead = (x[~later] for x in (gram, cover, own, text, low, more, ahead))
    part = (gram >> np.uint64(48)).astype(np.int64) % parts
    order = np.lexsort((low, text, part))
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        o = order[edges[p]:edges[p + 1]]
        if len(o):
            # Both digits whole: one anchor can stand in millions of surroundings.
            rows.append((p, block, OPEN, _packed(gram=gram[o], cover=cover[o], order=own[o], text=text[o].astype(np.int32),
                                                 low=low[o].astype(np.int32), more=more[o].astype(np.uint8), ahead=ahead[o].astype(np.uint8))))
    return rows


_NAMES = ["part", "block", "kind", "entries"]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _found(texts: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of the anchors of a block: gram, cover, order of the document, text, first suffix, how many more, place of the anchor."""
    found, first = [], 0
    for piece in common.pieces([texts], "text", STEP):
        gram, cover, text, *places = _anchored(*common.raw(common.column(piece, "text")))
        found.append((gram, cover, text + first, *places))
        first += piece.num_rows
    gram, cover, text, *places = map(np.concatenate, zip(*found))
    return gram, cover, common.column(texts, "order").to_numpy()[text], text, *places


def _deal(blocks: DataFrame, parts: int) -> DataFrame:
    """First digit: (part, block, kind, entries)."""
    def run(batches):
        for batch in batches:
            for block, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                gram, _, own, *_ = _found(pa.ipc.open_stream(stored).read_all().combine_chunks().to_batches()[0])
                yield _batch(_asked(block, parts, gram, own), _NAMES, _KINDS)

    return blocks.select("block", "data").mapInArrow(run, _ROWS)


def _settle(table: pa.Table) -> pa.Table:
    """Second or last digit, for one part: entries whose bytes an earlier document has are repeats; those whose anchor
    stands in other surroundings too stay open."""
    names, kinds = ["block", "kind", "entries"], [pa.int64(), pa.int32(), pa.binary()]
    through = table.filter(pa.compute.equal(table["kind"], REPEAT)).select(names)
    mine = table.filter(pa.compute.equal(table["kind"], OPEN))
    if not mine.num_rows:
        return through
    got = [_unpacked(b) for b in mine.column("entries").to_pylist()]
    block = np.repeat(mine.column("block").to_numpy(), [len(g["low"]) for g in got])
    one = {c: np.concatenate([g[c] for g in got]) for c in got[0]}
    gram, cover = one["gram"], one["cover"]
    order = np.lexsort((one["order"], cover, gram))
    gram, cover, own, block = gram[order], cover[order], one["order"][order], block[order]
    text, low, more, ahead = (one[c][order] for c in ("text", "low", "more", "ahead"))
    new_gram = np.append(True, gram[1:] != gram[:-1])
    new = new_gram | np.append(True, cover[1:] != cover[:-1])
    least = own[np.flatnonzero(new)]
    later = own > least[np.cumsum(new) - 1]
    # Anchors all of whose surroundings begin in one document repeat nothing further.
    starts = np.cumsum(new)[np.flatnonzero(new_gram)] - 1
    mixed = (np.minimum.reduceat(least, starts) != np.maximum.reduceat(least, starts))[np.cumsum(new_gram) - 1]
    open_ = ~later & mixed
    rows = [*_by_block(block[later], REPEAT, text[later], low[later], more[later]), *_by_block(block[open_], OPEN, text[open_], low[open_], more[open_], ahead[open_])]
    return pa.concat_tables([through.cast(pa.schema(list(zip(names, kinds)))), pa.Table.from_batches([_batch(rows, names, kinds)])])


def _texts(table: pa.Table) -> list[pa.RecordBatch]:
    return [pa.ipc.open_stream(b).read_all().combine_chunks().to_batches()[0] for b in table.column("data").to_pylist()]


def _entries(table: pa.Table, kind: int) -> tuple[np.ndarray, ...]:
    """text, low, more, ahead of the entries of one kind, by their place."""
    got = [_unpacked(b) for b in _blobs(table, kind)]
    text, low, more, ahead = (np.concatenate([np.zeros(0, np.int64), *[g[c].astype(np.int64) for g in got]]) for c in ("text", "low", "more", "ahead"))
    order = np.lexsort((low, text))
    return text[order], low[order], more[order], ahead[order]


def _blobs(table: pa.Table, kind: int) -> list[bytes]:
    return table.filter(pa.compute.equal(table["kind"], kind)).column("entries").to_pylist()


def remove(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``keep``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left of the text after each byte has gone that
    lies in a ``DEPTH``-byte string which also starts in a document with a smaller id. Runs jobs."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("order"), common.text_of(docs, text).alias("text"))
    limit = BLOCK

    def to_blocks(batches):
        task = TaskContext.get().taskAttemptId()
        for i, piece in enumerate(common.pieces(batches, "text", limit)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + i]), pa.array([common.column(piece, "text").nbytes], pa.int64()),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "data"])

    blocks = _cut(rows.mapInArrow(to_blocks, "block bigint, size bigint, data binary"))
    with tidy(docs.sparkSession):
        size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, int(size) // PART)
    told = "block bigint, kind int, entries binary"
    texts = blocks.select(F.col("block").alias("block"), "data")

    def with_texts(known: DataFrame, fn) -> DataFrame:
        """``fn`` of each block's number, texts and what is known of it; rows to deal."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if right.num_rows:
                block = right.column("block")[0].as_py()
                for batch in _texts(left):
                    rows += fn(block, batch, right)
            return pa.Table.from_batches([_batch(rows, _NAMES, _KINDS)])

        known = known.select(F.col("block").alias("block"), "kind", "entries")
        return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, _ROWS)

    def covers(block, batch, known):
        """Second digit, of the anchors that several documents have."""
        gram, cover, *places = _found(batch)
        shared = _told(_blobs(known, ANSWER), parts, gram)
        return _dealt(block, parts, *(x[shared] for x in (gram, cover, *places)))

    def halves_of(batch, known):
        data, off = common.raw(common.column(batch, "text"))
        text, low, more, ahead = _entries(known, OPEN)
        of, first, last, start, end = _halves(text, low, more, ahead, off[text])
        spans = common.Spans(data)
        own = common.column(batch, "order").to_numpy()
        return spans, off, text[of], (low[of] + first), last - first, spans.of(start, end), own[text[of]]

    def halves(block, batch, known):
        """Third digit, of the halves of open entries."""
        *_, digit, own = halves_of(batch, known)
        return _asked(block, parts, digit, own)

    def windows(block, batch, known):
        """Last digit: the suffixes of shared halves one by one, as entries of their own."""
        spans, off, text, low, more, digit, own = halves_of(batch, known)
        shared = _told(_blobs(known, ANSWER), parts, digit)
        text, low, more, own = text[shared], low[shared], more[shared], own[shared]
        half = np.repeat(np.arange(len(text)), more + 1)
        start = low[half] + np.arange(len(half)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        at = off[text[half]] + start
        none = np.zeros(len(at), np.int64)
        return _dealt(block, parts, spans.of(at, at + DEPTH), none.astype(np.uint64), own[half], text[half], start, none, none)

    answers = _cut(_deal(blocks, parts).groupBy("part").applyInArrow(_answer, told))
    entries = _cut(with_texts(answers, covers).groupBy("part").applyInArrow(_settle, told))
    open_ = entries.filter(F.col("kind") == OPEN)
    answers = _cut(with_texts(open_, halves).groupBy("part").applyInArrow(_answer, told))
    late = _cut(with_texts(open_.unionByName(answers), windows).groupBy("part").applyInArrow(_settle, told))
    marks = entries.unionByName(late).filter(F.col("kind") == REPEAT).select(F.col("block").alias("block"), "kind", "entries")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        of, low, more, _ = _entries(right, REPEAT)
        out = []
        for batch in _texts(left):
            data, off = common.raw(common.column(batch, "text"))
            change = np.bincount(off[of] + low, minlength=len(data) + 1) - np.bincount(off[of] + low + more + DEPTH, minlength=len(data) + 1)
            gone = np.cumsum(change)[:len(data)] > 0
            starts, _, text_of = common.runs(gone, off)
            n = batch.num_rows
            removed = common.per_text(gone, off)
            size = np.diff(off)
            ends = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~gone].tobytes())])
            out.append(pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(size), pa.array(removed), pa.array(np.bincount(text_of, minlength=n)), kept],
                [*[f"c{i}" for i in range(len(keep))], "n_bytes", "n_removed", "n_spans", "kept"]))
        return pa.Table.from_batches(out)

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    done = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        apply, f"{kinds}{', ' if kinds else ''}n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept")
