"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

``write`` deals documents by ranges of their id, encodes them and writes, for each partition,

* ``<part>.bin``  ids of all documents one after the other, unsigned 16-bit little-endian where the
  vocabulary allows it, else 32-bit;
* ``<part>.idx``  n + 1 unsigned 64-bit offsets into it, counted in ids;
* ``<part>.doc``  n signed 64-bit document ids, then n bytes: 1 where the id is null.

A stored manifest has one row for each part; its ``base`` is the prefix sum of the ids of earlier parts.
``read`` maps the files into memory and returns documents with their global start.

Defined cases: a null text is an empty one (only the end id); null document ids come first, repeated ids
stand together in no fixed order; one document of any length is in one part; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoscribe.llm import common, shards

#: Chunks that a worker remembers; beyond it the cache starts anew.
REMEMBERED = 900_000
#: New chunks that are encoded as one text.
JOINED = 4096
#: A blank and then no white space: such a chunk ends where the next one begins, whatever that is.
_PLAIN = re.compile(r" \S+")
#: Bytes that are, or may begin, white space. Texts with a blank before one are not cut into chunks.
_UNSURE = np.zeros(256, bool)
_UNSURE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters and digits, full stop and comma, and all signs that are seen, of ASCII.
_WORD, _STOPS, _SEEN = (np.isin(np.arange(256), list(x)) for x in (
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b".,", range(33, 127)))
#: A new chunk's parts: cut where a full stop or comma follows a letter or digit, and around a line break
#: that stands alone. Both are ends of tokens before any merge.
_PARTS = re.compile(r" ?[^ \n]*?[^\W_](?=[.,])|(?:(?<=\S)\n(?=\S))|(?: ?[^ \n]|(?<!\S)\n|\n(?!\S)| )(?:[^ \n]|(?<!\S)\n|\n(?!\S))*")


class Encoder:
    """The tokenizers library behind a cache of chunks.

    A chunk starts at a blank, at a full stop or comma behind a letter or digit, or at either side of a line break that stands
    alone. Byte-level pre-tokenization always starts a token at a blank that follows
    something else than white space, and a single blank in a stretch of white space never shares a token
    with what stands before it, so chunks are encoded as they are within the text. Texts with more
    blanks in a stretch, or with the string of an added token, go to the library whole."""

    def __init__(self, path: str, end: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre, post = said.get("pre_tokenizer") or {}, said.get("post_processor")
        self.chunked = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and said.get("normalizer") is None and post is None)
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        self.joins = self.chunked and not any(" " in a for a in self.added)
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end], self.width).tobytes()
        self.heads = np.zeros(self.library.get_vocab_size(), bool)
        if self.chunked:
            self.heads[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True
        self.chunks: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk. Chunks of a blank and what is not white space are encoded many in one text: the blank before each is
        the only one, so tokens that begin with a blank tell them apart."""
        texts = list(map(bytes.decode, chunks))
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)] if self.joins else []
        out: list[bytes | None] = [None] * len(chunks)
        joined = ["".join([texts[i] for i in plain[k:k + JOINED]]) for k in range(0, len(plain), JOINED)]
        flat = np.frombuffer(b"".join(self._ids(joined)), self.width)
        heads = np.flatnonzero(self.heads[flat])
        if len(heads) == len(plain):
            data = flat.tobytes()
            edges = [*(heads * self.width.itemsize).tolist(), len(data)]
            for i, s, e in zip(plain, edges, edges[1:]):
                out[i] = data[s:e]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._ids([texts[i] for i in rest])):
            out[i] = ids
        return out

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string column and the end id, as bytes."""
        data, off = common.raw(column)
        n, blob = len(off) - 1, data.tobytes()
        whole = np.full(n, not self.chunked)
        wide = np.flatnonzero((data[:-1] == 32) & _UNSURE[data[1:]])
        whole[np.searchsorted(off, wide, "right") - 1] = True
        if any(a.encode() in blob for a in self.added):
            whole |= np.array([any(a in t for a in self.added) for t in column.to_pylist()])
        cut = data == 32
        cut[off[:-1][np.diff(off) > 0]] = True
        # Of the cuts of ``_PARTS`` those that ASCII neighbours decide are made here, so that fewer chunks are distinct.
        cut[1:] |= _STOPS[data[1:]] & _WORD[data[:-1]]
        line = np.flatnonzero(data[1:-1] == 10) + 1
        line = line[_SEEN[data[line - 1]] & _SEEN[data[line + 1]]]
        cut[line] = cut[line + 1] = True
        start = np.flatnonzero(cut)
        of = np.searchsorted(off, start, "right") - 1
        plain = ~whole[of]
        edges = np.append(start, len(data)).astype(np.int32)
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(blob)])
        # Chunks are compared byte by byte.
        if not plain.all():
            chunks, of = chunks.filter(pa.array(plain)), of[plain]
        chunks = chunks.dictionary_encode()
        code = chunks.indices.to_numpy()
        ids = self._known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array(list(map(len, ids)), np.int64) // self.width.itemsize
        table = np.frombuffer(b"".join(ids), self.width)
        place = np.cumsum(size) - size
        count = size[code]
        before = np.cumsum(count) - count
        flat = table[np.repeat(place[code] - before, count) + np.arange(count.sum())].tobytes()
        edges = np.concatenate([[0], np.cumsum(np.bincount(of, count, n).astype(np.int64))]) * self.width.itemsize
        out = [flat[s:e] + self.end for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]
        full = np.flatnonzero(whole)
        for i, ids in zip(full, self._ids(column.take(pa.array(full)).to_pylist())):
            out[i] = ids + self.end
        return out

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks; new ones are encoded part by part."""
        ids = list(map(self.chunks.get, chunks))
        new = [i for i, x in enumerate(ids) if x is None]
        if len(self.chunks) + 2 * len(new) > REMEMBERED:
            self.chunks.clear()
            new = range(len(chunks))
        get = self.chunks.__getitem__
        parts, single = {}, []
        for c in [chunks[i] for i in new]:
            if b"." in c or b"," in c or b"\n" in c:
                parts[c] = tuple(map(str.encode, _PARTS.findall(c.decode())))
            else:
                single.append(c)
        learn = [*single, *set(chain.from_iterable(parts.values())).difference(self.chunks, single)]
        self.chunks.update(zip(learn, self._ids_of(learn)))
        self.chunks.update([(c, b"".join(map(get, p))) for c, p in parts.items() if len(p) != 1])
        for i in new:
            ids[i] = get(chunks[i])
        return ids


@lru_cache(maxsize=4)
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def write(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Write the files; the manifest: (part, folder, name, width, n_docs, n_ids, base). Runs a job."""
    spark = docs.sparkSession
    folder = shards.new_folder(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(docs, text).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        enc, (part, name) = encoder(model, end), shards.own_name()
        system, path = shards.for_writing(folder)
        offsets, ids = [np.zeros(1, np.uint64)], []
        total = 0
        with system.open_output_stream(f"{path}/{name}.bin") as out:
            for piece in common.pieces(batches, "text", 2 * common.PIECE):
                made = enc.encode(common.column(piece, "text"))
                out.write(b"".join(made))
                ends = np.cumsum([len(b) // enc.width.itemsize for b in made]).astype(np.uint64) + np.uint64(total)
                total = int(ends[-1])
                offsets.append(ends)
                ids.append(common.column(piece, "doc_id"))
        with system.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(np.concatenate(offsets).astype("<u8").tobytes())
        with system.open_output_stream(f"{path}/{name}.doc") as out:
            for column in ids:
                out.write(column.fill_null(0).to_numpy().astype("<i8").tobytes())
            for column in ids:
                out.write(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "folder": [folder], "name": [name],
            "width": pa.array([enc.width.itemsize], pa.int32()),
            "n_docs": pa.array([sum(map(len, ids))], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    manifest = common.cut(rows.mapInArrow(
        run, "part bigint, folder string, name string, width int, n_docs bigint, n_ids bigint"))
    # One row for each file, not for each document.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).cast("long"))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before; ids are a binary of
    little-endian unsigned 32-bit numbers."""
    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                system, path = shards.opened(m["folder"])
                width = np.dtype(f"<u{m['width']}")
                if not m["n_docs"]:
                    continue
                load = _mapped if system.type_name == "local" else _loaded
                offsets = load(system, f"{path}/{m['name']}.idx", "<u8")
                doc = load(system, f"{path}/{m['name']}.doc", "u1")
                n = m["n_docs"]
                ids, null = doc[:8 * n].view("<i8"), doc[8 * n:].astype(bool)
                flat = load(system, f"{path}/{m['name']}.bin", width)
                at, off = 0, offsets.astype(np.int64)
                while at < n:
                    to = max(at + 1, int(np.searchsorted(off, off[at] + common.PIECE // 4, "right")) - 1)
                    block = flat[off[at]:off[to]].astype("<u4")
                    edges = ((off[at:to + 1] - off[at]) * 4)
                    column = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), to - at, [None, pa.py_buffer(edges.astype("<i8").tobytes()), pa.py_buffer(block.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(ids[at:to]), mask=np.array(null[at:to])), pa.array(off[at:to] + m["base"]),
                         pa.array(off[at + 1:to + 1] - off[at:to]), column.cast(pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])
                    at = to

    spark: SparkSession = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _mapped(system, path: str, kind) -> np.ndarray:
    import os

    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _loaded(system, path: str, kind) -> np.ndarray:
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)
