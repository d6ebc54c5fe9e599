"""Filter audit against a plain walk through every order."""
import re
from itertools import permutations

import pytest

from chronoscribe.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def judged(rows):
    """(part, failed letters, good, toxic) of rows (id, text, source) with the table's labels."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    out = []
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        out.append((part or "", {f for f in bad if bad[f]}))
    return out


def walked(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    marked = [(p, bad, r[0] in good, r[0] in toxic) for r, (p, bad) in zip(rows, judged(rows))]
    want, shapley = {}, {}
    for part in {p for p, *_ in marked}:
        for order in permutations("ABCDE"):
            left = [m for m in marked if m[0] == part]
            mine = list(left)
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                want[part, "".join(order), step] = [
                    f, len(left), len(gone), sum(f in m[1] for m in mine) - len(gone), sum(m[1] == {f} for m in mine),
                    sum(m[2] for m in gone), sum(m[3] for m in gone)]
    return {k: (*v, shapley[k[0], v[0]]) for k, v in want.items()}


def case(spark, texts):
    rows = [(i, t, ["a", None, "b", ""][i % 4]) for i, t in texts]
    rows += [(rows[0][0], rows[0][1], "a"), (None, rows[0][1], "a"), (None, "lost", None), (None, None, "hot")]
    rows += [(90_000 + i, "many # copies " * 80, "hot") for i in range(300)] + [(95_000, "x " * 100_000 + "Z" * 100, "long")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 90_300, 7)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (14, None, None)]
    return rows, labels


def test_every_order(spark, texts):
    rows, labels = case(spark, texts)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mask string, n int").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in audit.audit(docs, lab).collect()}
    assert got == walked(rows, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in rows})


def test_nothing_and_other_filters(spark, none):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(none, lab, "ids").count() == 0
    docs = spark.createDataFrame([(1, "ab", "p"), (2, "a", "p"), (3, "b", "p")], "doc_id long, text string, source string")
    own = lambda t: {"X": t.contains("a"), "Y": t.contains("b")}
    got = {(r.filter_order, r.step): (r.removed, r.shapley) for r in audit.audit(docs, lab, filters=own, repeats=None).collect()}
    assert got == {("XY", 1): (2, 3), ("XY", 2): (1, 3), ("YX", 1): (2, 3), ("YX", 2): (1, 3)}
    with pytest.raises(ValueError):
        audit.failures(docs, lab, filters=lambda t: {c: t.contains(c) for c in "abcdefg"})


def test_paths():
    reach, leave = audit.path_counts(4)
    assert reach[0b1111] == leave[0] == 24 and reach[0b0101] == 2 and leave[0b0101] == 2 and reach[0b0111] == 6
