"""Context-tree weighting against the recursion on a dictionary of contexts."""
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from chronoscribe.llm import weighting


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(train, all_texts, depth):
    count = defaultdict(lambda: [0, 0])

    def decisions(t):
        b = b"\xff" * depth + low(t).encode() + b"\xff"
        for q in range(depth, len(b)):
            for k in range(8):
                yield b[q - depth:q], (1 << k) | (b[q] >> (8 - k)), (b[q] >> (7 - k)) & 1

    longer = defaultdict(set)
    for t in train:
        for ctx, node, bit in decisions(t):
            for d in range(depth + 1):
                count[ctx[depth - d:], node][bit] += 1
                if d:
                    longer[ctx[depth - d + 1:], node].add(ctx[depth - d:])

    def own(key):
        n0, n1 = count[key] if key in count else (0, 0)
        return math.lgamma(n0 + .5) + math.lgamma(n1 + .5) - math.lgamma(n0 + n1 + 1) - 2 * math.lgamma(.5)

    @lru_cache(None)
    def parts(ctx, node):
        e = own((ctx, node))
        if len(ctx) == depth:
            return e, e, 1.0
        s = sum(parts(c, node)[0] for c in longer[ctx, node])
        m = max(e, s)
        return math.log(.5) + m + math.log(math.exp(e - m) + math.exp(s - m)), e, 1 / (1 + math.exp(min(700, s - e)))

    def p1(ctx, node):
        p = None
        for d in range(depth, -1, -1):
            c = ctx[depth - d:]
            n0, n1 = count[c, node] if (c, node) in count else (0, 0)
            kt = (n1 + .5) / (n0 + n1 + 1)
            p = kt if p is None else parts(c, node)[2] * kt + (1 - parts(c, node)[2]) * p
        return p

    return [sum(math.log10(p1(c, n) if bit else 1 - p1(c, n)) for c, n, bit in decisions(t)) for t in all_texts]


def unigram(train, texts):
    count = Counter(x for t in train for x in [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None])
    n, v = sum(count.values()), len(count)
    out = []
    for t in texts:
        x = [count[w] for w in [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]]
        out.append((len(x), sum(c > 0 for c in x), n, sum(math.log10((c + 1) / (n + 1 * (v + 1))) for c in x)))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("none_trained", [False, True])
def test_scores(spark, texts, monkeypatch, none_trained):
    monkeypatch.setattr(weighting, "BLOCK", 3000)
    rows = [(i, (t or "")[:400] if t is not None else None) for i, t in texts[:-27:4]] + texts[-27:]
    df = spark.createDataFrame([(i, t, False, 1) for i, t in rows], "doc_id long, text string, held_out boolean, block int").repartition(3)
    flag = F.lit(True) if none_trained else F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = {r.doc_id: r for r in weighting.score(df, ["doc_id"], flag).collect()}
    train = [] if none_trained else [t for i, t in rows if not held(i)]
    want = brute(train, [t for _, t in rows], weighting.DEPTH)
    assert len(got) == len(rows)
    for (i, t), w, (n, known, total, base) in zip(rows, want, unigram(train, [t for _, t in rows])):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.held_out == (none_trained or held(i))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, w, rel_tol=1e-7, abs_tol=1e-7)


def test_learns_and_empty(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    flag = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    rows = weighting.score(docs, ["doc_id"], flag).groupBy("held_out").agg(F.avg("bits_per_byte").alias("b")).collect()
    bits = {r.held_out: r.b for r in rows}
    assert bits[False] < bits[True] < 3.5
    assert weighting.score(none, ["doc_id"], F.lit(False)).count() == 0
