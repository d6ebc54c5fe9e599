"""The join against all pairs, and the prefix tree against set operations."""
import random
import re

import numpy as np
import pytest

from chronoscribe.llm import prefix_tree as pt


def sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    return out


def brute(rows):
    s = sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(s[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, hash string").repartition(parts)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in pt.join(df).collect()), key=repr)
    assert got == brute(rows)
    kept = pt.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({d for d, _, c in got if d == c and d is not None})


def near_copies(rng, words, groups, size, edits):
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(t))
                t[k:k + 1] = rng.choice([[], [rng.choice(words)], [t[k], rng.choice(words)]])
            rows.append(" ".join(t))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(pt, "TREE", 4)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range([6, 60, 3000][seed])]
    texts = near_copies(rng, words, 12, 14, 4)
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [shared + " " + t for t in texts[:40]]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (906, "a b c d"), (None, texts[0]), (None, "q r s t u"), (3, texts[5]), (3, texts[3])]
    if len(set(texts)) > 3:
        rows = [r for r in rows if r[0] != 3] + [(3, texts[3]), (3, texts[3])]
    check(spark, rows)


def test_number_of_links(spark, monkeypatch):
    """Links inside groups of near copies are counted too, between different texts and equal ones."""
    monkeypatch.setattr(pt, "TREE", 4)
    rng = random.Random(5)
    texts = near_copies(rng, [f"w{i}" for i in range(300)], 6, 14, 4)
    rows = list(enumerate(texts + texts[:5] + ["", " ", None, "a b", "A  b"])) + [(None, texts[0]), (None, "q r s t u"), (3, texts[4]), (3, texts[4])]
    s = sets(rows)
    want = [sum(bool(x) and i != j and 100 * len(x & y) >= 85 * len(x | y) for j, y in enumerate(s)) for i, x in enumerate(s)]
    assert max(want) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in pt.join(df, links=True).collect()), key=repr)
    assert [x[:3] for x in got] == brute(rows)
    assert sorted([(x[0], x[3]) for x in got], key=repr) == sorted([(d, n) for (d, _), n in zip(rows, want)], key=repr)


def test_one_of_rows_without_an_id_or_of_one_id(spark):
    """Of linked rows of different texts one stays, also if none has an id or all have the same."""
    words = [[f"g{g}w{i}" for i in range(100)] for g in range(4)]
    copies = lambda g: [" ".join(words[g]), *[" ".join(words[g][:-1] + [f"e{k}"]) for k in range(3)]]
    rows = [*[(None, t) for t in copies(0)], *[(7, t) for t in copies(1)], *zip((None, 9, 9, None), copies(2)), *[(7, t) for t in copies(3)[:2]], (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = pt.one_of_each(df).collect()
    assert set(kept) <= set(df.collect())
    group = lambda r: (r.doc_id, r.text.partition("w")[0])
    assert sorted(map(group, kept), key=repr) == sorted([(None, "g0"), (7, "g1"), (9, "g2"), (7, "g3"), (None, "")], key=repr)


def test_chain_of_links(spark):
    """Neighbours link, the ends do not: one component nevertheless."""
    words = [f"v{i}" for i in range(400)]
    check(spark, [(50 - i, " ".join(words[4 * i:4 * i + 100])) for i in range(40)])


def test_documents(spark, texts):
    check(spark, texts)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, ""), (2, None)])


def test_tree_links():
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = rng.choice(500, rng.integers(1, 200), replace=False)
        probe = np.unique(base).astype(np.uint64)
        members = []
        for _ in range(rng.integers(0, 12)):
            keep = base[rng.random(len(base)) > rng.choice([0, .05, .1, .3])]
            members.append(np.unique(np.concatenate([keep, rng.choice(500, rng.integers(0, 20))])).astype(np.uint64))
        members = [m for m in members if len(m)]
        want = [i for i, m in enumerate(members) if 100 * len(np.intersect1d(m, probe)) >= 85 * len(np.union1d(m, probe))]
        assert sorted(pt.tree_links(probe, members)) == want
