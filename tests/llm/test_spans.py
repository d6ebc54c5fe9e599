"""Hashes of spans: the same wherever a span stands, different for regular strings that simple sums confuse."""
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from chronoscribe.llm import common, prefix_tree, quality, radix, tokens, weighting, winnow


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


#: Pairs of different strings whose sums of powers are equal modulo 2**64 for every odd base.
PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (512, 1024, 2048, 8192)]


def test_spans_stand_anywhere():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 3, 5000).astype(np.uint8)
    seen = {}
    spans = common.Spans(data)
    starts = rnd.integers(0, 4900, 20_000)
    ends = starts + rnd.integers(0, 12, 20_000)
    for s, e, h in zip(starts, ends, spans.of(starts, ends)):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    assert (spans.grams(7) == spans.of(np.arange(4994), np.arange(4994) + 7)).all()
    words = common.Spans(rnd.integers(0, 1 << 63, 50, dtype=np.uint64))
    assert len(set(words.of(np.arange(49), np.arange(49) + 1).tolist())) == 49
    assert len(common.Spans(np.zeros(0, np.uint8)).grams(3)) == 0


@pytest.mark.parametrize("a,b", PAIRS)
def test_regular_strings_differ(a, b):
    data = np.frombuffer((a + b).encode(), np.uint8)
    n = len(a)
    h = common.Spans(data).of(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    codes = np.where(data == 97, np.uint64(3), np.uint64(5)).astype(np.uint64)
    h = common.Spans(codes).of(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_operators_tell_regular_words_apart(spark):
    a, b = PAIRS[1]
    off = np.array([0, len(a), len(a) + len(b)])
    data = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(winnow._words(data, off)[0].tolist())) == 2
    assert len(set(prefix_tree.shingles(data, off)[0].tolist())) == 2
    texts = rows(spark, f"{a}\n{b}\n", f"{a}\n{a}\n")
    got = {r.doc_id: r.n_dup_lines for r in quality.ledger(texts).select("doc_id", "ledger.*").collect()}
    assert got == {0: 0, 1: 1}
    lib = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    made = lib.encode(pa.array([a, b, f"x {a} {b}"]))
    for text, ids in zip([a, b, f"x {a} {b}"], made):
        want = lib.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u2").tolist() == [*want, 0]


def test_regular_words_in_whole_queries(spark):
    a, b = PAIRS[1]
    known = weighting.score(rows(spark, a, b, "c"), ["doc_id"], __import__("pyspark").sql.functions.col("doc_id") == 1)
    assert {r.doc_id: r.n_known for r in known.collect()} == {0: 2, 1: 1, 2: 2}
    kept = {r.doc_id: r for r in radix.remove(rows(spark, a, b + "!", a + "?"), ["doc_id"]).collect()}
    texts = [a, b + "!", a + "?"]
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            if any(t[s:s + 50] in e for e in texts[:i]):
                gone[s:s + 50] = True
        left = "".join(c for c, g in zip(t, gone) if not g)
        assert hashlib.sha256(bytes(kept[i].kept)).hexdigest() == hashlib.sha256(left.encode()).hexdigest()
