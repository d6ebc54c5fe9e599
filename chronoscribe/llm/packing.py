"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

``cut_pieces`` encodes documents, ends each with an end id and cuts those above the capacity into pieces. The plan is
made from the histogram of piece lengths alone, which has one count a length and so never grows with the table:

* exact fills: bins are opened with the longest length left; the sums of one, two and three available lengths
  are looked up by the gap that is left, and a combination that fills it exactly is consumed as often as its
  availability counts allow. Where none is found, the longest length that fits goes in and the smaller gap is looked up;
* what no exact fill takes goes to the bin with the least gap that holds it, longest first.

Bins of one pattern are planned together, with a count. Each step uses up a length or a kind of gap, so the plan has some
rows a length, however many pieces there are. Pieces are numbered within their length (a running number within the
task, plus the sum of earlier tasks), and the plan turns (length, number) into a sequence and an offset.

Defined cases: a null text is an empty one, which is the end id alone; documents with a null or repeated id are packed
like others; which of several pieces of equal length goes where is not defined; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoscribe.llm import common

#: Chunks, and characters of them, that a worker remembers; beyond either the memory starts anew.
REMEMBERED, CHARACTERS = 500_000, 16 << 20
#: Words that normalization leaves a single run of letters: such a word is one word of the tokenizer.
_PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: The pattern that the cuts below hold for; a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER


class Encoder:
    """The tokenizers library behind a memory of chunks.

    Where the tokenizer drops white space, splits by ``_PATTERN`` and normalizes nothing across ASCII signs, a text is cut at blanks
    and line breaks, around digits, behind letters before a sign, and behind a sign other than ``'`` before a letter. Each is an end of
    a word of the pattern whatever stands around it. New plain words are encoded many in one call, and told apart by the mark
    that each word's last token has. For all other tokenizers whole texts go to the library."""

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        normal = {n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])}
        suffix = said["model"].get("end_of_word_suffix")
        self.added = [t["content"].encode() for t in said.get("added_tokens", [])]
        self.chunked = ((split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
                        and split["pattern"].get("Regex") == _PATTERN and normal <= {"NFC", "Replace", "Lowercase"} and bool(suffix)
                        and said.get("post_processor") is None
                        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].isprintable() or " " in t["content"]
                                    for t in said.get("added_tokens", [])))
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        if self.chunked:
            for token, i in said["model"]["vocab"].items():
                self.last[i] = token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.first, self.characters = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [c for c in new if _PLAIN.fullmatch(c)]
        other = [c for c in new if not _PLAIN.fullmatch(c)]
        ids = [self._ids([" ".join(plain[i:i + 4096]) for i in range(0, len(plain), 4096)])] if plain else []
        words = np.concatenate([np.zeros(0, np.uint32), *chain(*ids)])
        ends = np.flatnonzero(self.last[words]) + 1
        if len(ends) != len(plain):
            raise AssertionError("a plain word has not one end")
        rest = self._ids(other)
        sizes = np.concatenate([np.diff(ends, prepend=0), np.array(list(map(len, rest)), np.int64)])
        self.flat = np.concatenate([self.flat, words, *rest])
        n = len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.place.update(zip(chain(plain, other), range(n, n + len(new))))
        self.characters += sum(map(len, new))

    def _places(self, chunks: list[str]) -> np.ndarray:
        if len(self.place) + len(chunks) > REMEMBERED or self.characters > CHARACTERS:
            self._forget()
        at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn([chunks[i] for i in new.tolist()])
            at[new] = [self.place[chunks[i]] for i in new.tolist()]
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after the other, and their number up to each text."""
        data, off = common.raw(column)
        if not self.chunked:
            ids = self._ids(column.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
        gap = (data == 32) | (data == 10)
        cut = np.zeros(len(data), bool)
        cut[off[:-1][np.diff(off) > 0]] = True
        cut[1:] |= gap[:-1]
        blob = data.tobytes()
        if not any(a in blob for a in self.added):
            kind = _KIND[data]
            a, b = kind[:-1], kind[1:]
            known = (a > 0) & (b > 0)
            cut[1:] |= known & ((a == _DIGIT) | (b == _DIGIT) | ((a == _LETTER) & (b == _SIGN)) | ((a == _SIGN) & (b == _LETTER) & (data[:-1] != 39)))
        start = np.flatnonzero(cut & ~gap)
        before = np.concatenate([[0], np.cumsum(~gap)])
        edges = np.append(before[start], before[-1]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(edges), pa.py_buffer(data[~gap])).dictionary_encode()
        at = self._places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        first = self.first[at]
        count = self.first[at + 1] - first
        upto = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(start, off, "left")]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(docs: DataFrame, model: str, capacity: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, task, nth): the pieces, stored. ``ids`` are little-endian unsigned 32-bit
    numbers; ``nth`` counts the pieces of one length within the task that wrote them. Runs a job."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), common.text_of(docs, text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc, task = encoder(model), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in common.pieces(batches, "text", 2 * common.PIECE):
            flat, upto = enc.encode(common.column(batch, "text"))
            n_ids = np.diff(upto) + 1
            whole = np.insert(flat, upto[1:], np.uint32(end)).astype("<u4")
            edge = np.concatenate([[0], np.cumsum(n_ids)])
            n = -(-n_ids // capacity)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(n.sum()) - (np.cumsum(n) - n)[of]
            length = np.minimum(n_ids[of] - piece * capacity, capacity)
            # Numbers within a length: the place in a stable order by length, less the place of the length's first.
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order], "left")
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - first
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            bounds = np.append(edge[of] + piece * capacity, edge[-1]) * 4
            blob = whole.tobytes()
            view = memoryview(blob)
            crc = [zlib.crc32(view[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(blob)])
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length),
                 ids.cast(pa.binary()), pa.array(crc, pa.int64()), pa.array(np.full(len(of), task, np.int64)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"])

    return common.cut(rows.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, task bigint, nth bigint"))


class Sums:
    """Available lengths, looked up by the sum of one, two or three of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.index()

    def index(self) -> None:
        """Sums of two available lengths. Availability only shrinks, so an older index says too much, never too little."""
        have = self.counts > 0
        self.pairs = np.rint(np.convolve(have, have)).astype(np.int64)[:len(have)] > 0
        self.stale = 0

    def _left(self, used: Counter) -> np.ndarray:
        left = self.counts.copy()
        for length, n in used.items():
            left[length] -= n
        return left

    def pair(self, left: np.ndarray, gap: int) -> tuple[int, int] | None:
        a = np.arange(1, gap // 2 + 1)
        n = np.minimum(left[a], left[gap - a])
        if gap % 2 == 0 and len(n):
            n[-1] = left[gap // 2] // 2
        # Of several pairs the one that can be used most often.
        return None if not len(n) or n.max() <= 0 else (int(gap - a[n.argmax()]), int(a[n.argmax()]))

    def exact(self, used: Counter, gap: int) -> tuple[int, ...] | None:
        """One to three lengths that are left beside ``used`` and sum up to ``gap``."""
        left = self._left(used)
        if left[gap] > 0:
            return (gap,)
        if self.pairs[gap]:
            found = self.pair(left, gap)
            if found:
                return found
            self.stale += 1
        first = np.arange(1, gap - 1)
        first = first[(left[first] > 0) & self.pairs[gap - first]]
        for a in first[np.argsort(-left[first], kind="stable")].tolist():
            left[a] -= 1
            found = self.pair(left, gap - a)
            if found:
                return (a, *found)
            left[a] += 1
            self.stale += 1
        if self.stale > 64:
            self.index()
        return None


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Patterns for a histogram of lengths: (number of bins, {length: pieces of it in each bin}). ``len(counts) - 1`` is
    the capacity."""
    capacity = len(counts) - 1
    counts = counts.astype(np.int64).copy()
    patterns: list[tuple[int, Counter]] = []
    if counts[capacity]:
        patterns.append((int(counts[capacity]), Counter({capacity: 1})))
        counts[capacity] = 0
    sums, rest = Sums(counts), np.zeros_like(counts)
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            used, gap = Counter({length: 1}), capacity - length
            found = None
            while gap:
                found = sums.exact(used, gap)
                if found:
                    used.update(found)
                    break
                # No exact fill yet: as many as fit of the longest length that does.
                left = np.flatnonzero(sums._left(used)[:gap + 1] > 0)
                if not len(left):
                    break
                used[int(left[-1])] += 1
                gap -= int(left[-1])
            if not found:
                rest[length] += counts[length]
                counts[length] = 0
                break
            times = min(int(counts[x]) // n for x, n in used.items())
            patterns.append((times, used))
            for x, n in used.items():
                counts[x] -= times * n
    return patterns + best_fit(rest)


def best_fit(counts: np.ndarray) -> list[tuple[int, Counter]]:
    """Longest first, each to a bin with the least gap that holds it; bins of one pattern and gap are filled together."""
    capacity = len(counts) - 1
    open_: dict[int, list[tuple[int, Counter]]] = {}
    gaps: list[int] = []

    def put(gap: int, n: int, pattern: Counter) -> None:
        if n:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((n, pattern))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                n, pattern = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[i]
            else:
                gap, pattern = capacity, Counter()
                n = -(-left // (capacity // length))
            # A bin stays the one with the least gap until it holds no more.
            each = gap // length
            full = min(n, left // each)
            put(gap - each * length, full, pattern + Counter({length: each}))
            left -= full * each
            if full < n and left:
                put(gap - left * length, 1, pattern + Counter({length: left}))
                full, left = full + 1, 0
            if pattern:
                put(gap, n - full, pattern)
    return [p for of_gap in open_.values() for p in of_gap]


def places(patterns: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The plan for pieces numbered within their length: sorted keys (length and first number), and for each of them
    (first number, pieces a bin, first sequence, offset)."""
    used: Counter = Counter()
    keys, rows, sequence = [], [], 0
    for times, pattern in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            keys.append(length << 44 | used[length])
            rows.append((used[length], n, sequence, offset))
            used[length] += times * n
            offset += length * n
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(rows, np.int64).reshape(-1, 4)[order]


def pack(docs: DataFrame, model: str, capacity: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset): every piece with its sequence and its place there. Sequences
    are numbered from 0; ``offset`` counts ids. Runs jobs for the pieces and their histogram."""
    pieces = cut_pieces(docs, model, capacity, end, doc_id, text)
    counts = common.cut(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    # At most one row a length.
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    keys, rows = places(plan(histogram))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(), number.to_numpy()
        first, each, sequence, offset = rows[np.searchsorted(keys, size << 44 | nth, "right") - 1].T
        return pd.DataFrame({"sequence_id": sequence + (nth - first) // each, "offset": offset + (nth - first) % each * size})

    # One row for each task and length, not for each piece.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("base"))
    out = pieces.join(base, ["task", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return out.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, n_pieces, ids, starts): the packed sequences, with the offset of each of their pieces. A sequence has at
    most as many pieces as ids."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.count(F.lit(1)).alias("n_pieces"), held.alias("held")).select(
        "sequence_id", "n_ids", "n_pieces", F.aggregate("held.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("held.offset").alias("starts"))
