"""Repeated windows against a dictionary of all windows."""
import random

import numpy as np
import pytest

from chronoscribe.llm import radix


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def check(spark, rows, parts=4):
    last = 1 << 62
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, kept binary, block int").repartition(parts)
    got = [(r.doc_id if r.doc_id is not None else last, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in radix.remove(df, ["doc_id"]).collect()]
    assert sorted(got, key=repr) == brute([(last if i is None else i, t) for i, t in rows])


@pytest.mark.parametrize("seed", range(3))
def test_planted_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK", 5000)
    rng = random.Random(seed)
    letters = ["ab", "abcdefghijklmnop é日", "a"][seed]
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [text(rng.choice([49, 50, 51, 60, 90, 400])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice([text(rng.randint(0, 80)), rng.choice(pool), rng.choice(pool)[rng.randint(0, 20):]]) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[5][1]), (101, rows[5][1]), (None, rows[7][1]), (None, rows[7][1]), (-4, pool[0]), (200, None), (201, "")]
    check(spark, rows)


def test_edges_of_copies(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(0, base)]
    for i in range(1, 30):  # the same passage with other neighbours, or with one letter changed
        lo = rng.randint(0, 2800)
        piece = list(base[lo:lo + rng.randint(45, 200)])
        if rng.random() < .5 and len(piece) > 60:
            piece[rng.randrange(len(piece))] = "Z"
        rows.append((rng.randint(-50, 50), f"{i}" * 30 + "".join(piece) + f"<{i}>" * 10))
    check(spark, rows)


def test_surroundings_alike_in_half_their_hash(spark, monkeypatch):
    """One anchor in two surroundings whose hashes have the same low 32 bits: nothing is repeated."""
    monkeypatch.setattr(radix, "BLOCK", 50)  # a block for each text
    rng = np.random.default_rng(3)
    heads = rng.integers(97, 123, (200_000, 20), dtype=np.uint8)
    head = heads[radix.common.Spans(heads.reshape(-1)).grams(20)[::20].argmin()]
    data = np.concatenate([np.tile(head, (300_000, 1)), rng.integers(97, 123, (300_000, 30), dtype=np.uint8)], 1)
    gram, cover, text, _, _ = radix.anchors(data.reshape(-1), np.arange(len(data) + 1) * 50)
    cover, text = (x[gram == radix.common.Spans(head).grams(20)[0]] for x in (cover, text))
    order = np.argsort(cover.astype(np.uint32))
    half = cover[order].astype(np.uint32)
    at = np.flatnonzero(half[1:] == half[:-1])
    assert len(at)
    rows = []
    for i in at[:3]:
        rows += [(len(rows) + k, data[text[order[i + k]]].tobytes().decode()) for k in (0, 1)]
    check(spark, rows)


def test_documents(spark, texts):
    check(spark, texts)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, "short"), (2, "short")])


def test_strings_shared_in_part(spark, monkeypatch):
    """Strings of less than 50 bytes, of 50 and of more that documents share at either side of other bytes."""
    monkeypatch.setattr(radix, "BLOCK", 400)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    pool = [text(n) for n in range(20, 80)]
    check(spark, [(rng.randint(-20, 20), "".join(text(rng.randint(0, 30)) + rng.choice(pool) for _ in range(6))) for _ in range(200)])


def test_first_digit_is_small(spark):
    """What leaves a block of texts with nothing in common is less than half of the texts (before: more than the texts)."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    size = 1 << 21
    letters = rng.integers(97, 123, size, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_pydict({"order": pa.array(range(1024), pa.int64()), "text": [letters[i:i + 2048] for i in range(0, size, 2048)]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    blocks = spark.createDataFrame([(1, size, sink.getvalue().to_pybytes())], "block long, size long, data binary")
    assert 0 < radix._deal(blocks, 64).selectExpr("sum(length(entries))").first()[0] < size // 2


def test_shuffle_files_go_with_their_jobs(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = files()
    letters = "".join(random.Random(2).choice("abcdefgh ") for _ in range(20_000))
    radix.remove(spark.createDataFrame([(i, letters[i * 100:]) for i in range(20)], "doc_id long, text string"), ["doc_id"])
    assert not files() - before
