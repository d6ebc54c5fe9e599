"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

A text is its symbols (characters, blanks as ``\\u2581`` with one in front). An agenda holds the adjacent
pairs whose joint piece is in the vocabulary, best score first and leftmost among equals; the head is
merged, its new neighbours enter, until nothing is left. Symbols without a piece become byte pieces.

No piece has a blank mark after another character, and none holds a line break; both are checked when the
model is loaded. So no merge crosses from a word to the next blank, or a line break, and words are encoded
one by one and remembered in a cache of bounded size. Every newly encoded word of an Arrow batch is
compared with the library in one call; with ``check="texts"`` whole texts are.

Defined cases: a null text is an empty one (only the begin and end ids); a text of any length is encoded
whole; repeated rows are encoded alike; an empty table gives an empty one; columns of the input pass
through, and the new column has the name that the caller gives (``common.fresh`` finds a free one).
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe.llm import common

BLANK = "▁"
#: Words that a worker remembers; beyond it the cache starts anew.
REMEMBERED = 300_000
#: Words of at most so many characters are merged many at a time.
SHORT = 48
_NONE = np.int32(1 << 30)


class Vocabulary:
    """Pieces and merge ranks of a model file, and the library's processor to compare with."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i)
        size = lib.get_piece_size()
        self.ids = {lib.id_to_piece(i): i for i in range(size) if not special(i)}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.bytes = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        if any(BLANK in p.lstrip(BLANK) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("a piece of this vocabulary crosses words")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.words: dict[str, bytes] = {}
        # The pairs of ids that make a piece, sorted, with the piece's place among all pieces by score.
        by_rank = sorted(self.rank, key=self.rank.get)
        self.made = np.array([self.ids[p] for p in by_rank] or [0], np.int32)
        pairs = {(self.ids[p[:i]] << 32) | self.ids[p[i:]]: r for r, p in enumerate(by_rank)
                 for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids}
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.ranks = np.array([pairs.get(int(k), _NONE) for k in self.pairs], np.int32)
        self.single = np.zeros(0x110000, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``_NONE`` for those that make no piece."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left > 0) & (right > 0), self.ranks[at], _NONE)

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, whose agendas advance together: one row of pair ranks for each word,
        the least and leftmost of a row is its head."""
        n, size = len(words), len(words[0])
        ids = self.single[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")].reshape(n, size).copy()
        rank = np.full((n, size + 1), _NONE, np.int32)
        rank[:, :size - 1] = self.look_up(ids[:, :-1], ids[:, 1:])
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
        ids = np.concatenate([ids, np.zeros((n, 1), np.int32)], 1)  # an end that joins nothing
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(1)
            best = rank[rows, at]
            live = best < _NONE
            rows, at, best = rows[live], at[live], best[live]
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at], ids[rows, gone] = self.made[best], -1
            after[rows, at] = then
            before[rows, then] = at
            rank[rows, gone] = _NONE
            rank[rows, at] = self.look_up(ids[rows, at], ids[rows, then])
            prior = before[rows, at]
            has = prior >= 0
            r, p = rows[has], prior[has]
            rank[r, p] = self.look_up(ids[r, p], ids[r, at[has]])
        ids = ids[:, :size]
        flat = ids[ids >= 0].astype("<u4").tobytes()
        ends = np.cumsum((ids >= 0).sum(1)) * 4
        out, start = [], 0
        for end in ends.tolist():
            out.append(flat[start:end])
            start = end
        for i in np.flatnonzero((ids == 0).any(1)):  # symbols without a piece
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of a word by the agenda."""
        symbols, rank = list(word), self.rank
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, symbols[i] + symbols[i + 1]))
        if agenda:
            heapify(agenda)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            while agenda:
                _, i, piece = heappop(agenda)
                left = symbols[i]
                j = after[i]
                if not left or j >= n or left + symbols[j] != piece:
                    continue  # one of the two has been merged meanwhile
                symbols[i], symbols[j] = piece, ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = rank.get(piece + symbols[k])
                    if r is not None:
                        heappush(agenda, (r, i, piece + symbols[k]))
                h = before[i]
                if h >= 0:
                    r = rank.get(symbols[h] + piece)
                    if r is not None:
                        heappush(agenda, (r, h, symbols[h] + piece))
        out, ids = [], self.ids
        for s in symbols:
            if s:
                got = ids.get(s)
                if got is None:
                    out.extend(self.bytes[b] for b in s.encode())
                else:
                    out.append(got)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words and compare them with the library."""
        words.sort(key=len)
        got: list[bytes] = []
        for size, group in groupby(words, len):
            group = list(group)
            if size > SHORT:
                got += [np.array(self.merge(w), "<u4").tobytes() for w in group]
            else:
                for i in range(0, len(group), 20_000):
                    got += self.merge_many(group[i:i + 20_000])
        # A line break stands alone, so what follows it is encoded without a blank in front.
        said = self.library.encode(["\n" + w.replace(BLANK, " ") for w in words], num_threads=1)
        lead = 2
        flat = np.array(list(chain.from_iterable(b[lead:] for b in said)), "<u4").tobytes()
        if b"".join(got) != flat or any(len(a) != 4 * (len(b) - lead) for a, b in zip(got, said)):
            raise AssertionError("agenda and library differ")
        self.words.update(zip(words, got))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


def encode_texts(voc: Vocabulary, texts: list[str], check: str = "words") -> list[bytes]:
    """Ids of each text with begin and end, as little-endian 32-bit numbers."""
    begin, end = np.array([voc.begin], "<u4").tobytes(), np.array([voc.end], "<u4").tobytes()
    cut = [_WORDS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
    new = set().union(*cut).difference(voc.words)
    if len(voc.words) + len(new) > REMEMBERED:
        new = set().union(*cut)
        voc.words.clear()
    if new:
        voc.learn(list(new))
    get = voc.words.__getitem__
    out = [begin + b"".join(map(get, words)) + end for words in cut]
    if check == "texts":
        said = voc.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        if any(np.array(b, "<u4").tobytes() != a for a, b in zip(out, said)):
            raise AssertionError("agenda and library differ")
    return out


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", check: str = "words") -> DataFrame:
    """``docs`` with a binary column ``ids``: little-endian unsigned 32-bit ids, begin and end included.

    ``model`` is the path of a model file that every worker has."""
    whole = common.fresh(docs, "whole_text")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())])
    names = docs.columns

    def run(batches):
        voc = vocabulary(model)
        for piece in common.pieces(batches, whole, 2 * common.PIECE):
            out = pa.array(encode_texts(voc, common.column(piece, whole).to_pylist(), check), pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns[:len(names)], out], [*names, ids])

    return docs.withColumn(whole, common.text_of(docs, text)).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``text``, decoded from the ids by the library; null ids give an empty text."""
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    names = rows.columns
    whole = common.fresh(rows, "some_ids")

    def run(batches):
        lib = vocabulary(model).library
        for piece in common.pieces(batches, whole):
            lists = [np.frombuffer(b, "<u4").tolist() for b in common.column(piece, whole).to_pylist()]
            out = pa.array(lib.decode(lists, num_threads=1) if lists else [], pa.string())
            yield pa.RecordBatch.from_arrays([*piece.columns[:len(names)], out], [*names, text])

    return rows.withColumn(whole, F.coalesce(rows[ids], F.lit(b""))).mapInArrow(run, schema)
