"""Spelling variants against plain loops over all pairs of words."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronoscribe.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def edits(word):
    """Strings that two words at a distance of one, or equal ones, have in common: the word, and it with a gap or without a letter."""
    yield 0, word
    for i in range(len(word)):
        yield 1, word[:i] + "\0" + word[i + 1:]
        yield 2, word[:i] + word[i + 1:]


def grouped(n):
    near = defaultdict(set)
    gaps, cut = defaultdict(list), defaultdict(set)
    for w in n:
        for kind, e in edits(w):
            if kind == 1:
                gaps[e].append(w)
            if kind == 2:
                cut[e].add(w)
    for ws in gaps.values():
        for a in ws:
            near[a].update(x for x in ws if x != a)
    for w in n:
        for longer in cut.get(w, ()):
            near[w].add(longer)
            near[longer].add(w)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * c:
            form[w] = best
    out = {}
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, c, len(near[w]), n[form[w]] if w in form else None)
    return out


def table(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def invented(seed):
    """Words with many variants, common beginnings and endings, repeats of one letter, accents and long words."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(["tion", "pre", "an", "é", "ø", "str", "a", "b", "mm"]) for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "ababababa", "nation", "station", "nations", "ñandúes", "x" * 64, "x" * 65, "x" * 66, "xy" * 600, "xy" * 600 + "x"]
    n = Counter()
    for w in base:
        n[w] += rnd.choice([5, 30, 200, 1000])
        for _ in range(12):
            i, c = rnd.randrange(len(w) + 1), rnd.choice("aeiéz")
            v = rnd.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]])
            n[v] += rnd.choice([5, 6, 25, 150])
    return {w: c for w, c in n.items() if len(w) >= 6}


@pytest.mark.parametrize("frequent,longest", [(50, 6), (2, 6), (0, 6), (0, 3), (10**9, 6)])
def test_every_near_pair(spark, frequent, longest):
    n = invented(frequent % 7 + longest)
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert table(spelling.variants(vocabulary, frequent=frequent, longest=longest)) == grouped(n)


def test_grams(spark):
    vocabulary = spark.createDataFrame([(f"abcde{c}", 9) for c in "fghij"] + [("zzzzzz", 5)], "word string, n long")
    rows = {r.key: r for r in spelling.decompose(vocabulary, frequent=3, longest=4).collect()}
    # Frequent beginnings are extended to the longest, what follows tells the endings apart.
    assert [g.gram for g in rows["abcdef"].grams] == ["^abc", "abcd", "bcde", "cdef", "def", "ef", "f$"]
    assert rows["abcdef"].affected == 4
    assert [g.gram for g in rows["zzzzzz"].grams] == ["^z", "zzz", "zzz", "zzz", "zzz", "zz$", "z$"] or rows["zzzzzz"].affected < 7


def test_documents(spark, texts, none):
    rows = texts + [(None, "Another anothe ANOTHER another anothes another"), (None, None)] + [(70_000 + i, "hotword " * 40 + "Ångström ångström") for i in range(300)]
    rows += [(80_000 + i, "q" * 3000 + " " + "q" * 2999) for i in range(5)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    vocabulary = spelling.words(docs, misspelt=F.col("h") % 199 == 0)
    n = counted(rows)
    assert {r.word: r.n for r in vocabulary.collect()} == n and n["hotword"] > 5000
    got = table(spelling.variants(vocabulary))
    assert got == grouped(n) and any(v[0] for v in got.values())
    assert spelling.variants(spelling.words(none)).count() == 0


def test_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("v", "w0")], "word string, form string")
    assert {r.word: r.root for r in spelling.follow(forms).collect()} == {**{f"w{i}": "w20" for i in range(20)}, "v": "w20"}


def test_nothing_is_broadcast(spark, monkeypatch):
    """The vocabulary's file is small, its exploded grams are not: no join may send a side to all by the size of the file."""
    plans, cut = [], spelling.common.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(spelling.common, "cut", seen)
    words = [("spelling", 100), ("speling", 10), ("spellings", 2), ("spelings", 1), ("x" * 70, 60), ("x" * 71, 6)]
    vocabulary = cut(spark.createDataFrame(words, "word string, n long"))
    found = spelling.variants(vocabulary)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.word: r.root for r in found.collect()} == dict(zip([w for w, _ in words], ["spelling"] * 4 + ["x" * 70] * 2))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
