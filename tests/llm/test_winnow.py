"""Decontamination against a search for every run of words."""
import random
import re

from chronoscribe.llm import winnow


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            runs = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k:k + n]) in runs:
                    hit |= set(range(k, k + n))
                    found.add("" if item is None else str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, n_words string")
    rows = winnow.find(d, b, ["doc_id"]).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows}
    assert got == brute(docs, items)
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_hit for r in rows)
    clean = winnow.drop_hits(d, b)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, x in got.items() if not x[1])


def test_random_words(spark):
    rng = random.Random(3)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))  # noqa: E731  few words: many meetings and ties
    items = [(i, text(rng.choice([1, 4, 9, 10, 11, 14, 25]), rng.choice([1, 2, 4, 8]))) for i in range(12)] + [(90, None), (91, ""), (92, "."), (None, text(12, 4))]
    items += [(3, items[3][1])]
    docs = [(i, text(rng.choice([0, 3, 9, 10, 40, 300]), rng.choice([1, 2, 4, 8]))) for i in range(60)] + [(100, None), (101, "")]
    docs += [(200 + k, text(20, 8) + " " + items[k][1] + ". " + text(15, 8)) for k in range(12)]
    check(spark, docs, items)


def test_documents(spark, texts):
    import duckdb
    items = duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    check(spark, texts, items)


def test_empty(spark, texts):
    check(spark, texts[:20], [])
    check(spark, [], [(1, "a b c")])
