"""Reply trees against a recursive walk, and the format's round trip."""
import hashlib
import random

from pyspark.sql import functions as F

from chronoscribe.llm import chat
from chronoscribe.llm.queries import QUERIES

SCHEMA = "tree long, node long, parent long, score double, role string, text string, leaf int"
HARD = ["", None, "\\", "\\\\h", "###", "####  #", "</turn>\n", "\\### Assistant: </turn> ok", "<</turn>", "### user: x</turn>\n", "\\h\\l\\c", "é日😀", "a\nb", "##"]


def paths(rows):
    """For each tree its root-to-leaf paths as lists of nodes."""
    by = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows}
    out = {}
    for tree, node, *_ in rows:
        if (tree, node) in parents:
            continue
        way, at = [], (tree, node)
        while at in by and at not in way:
            way.append(at)
            at = (tree, by[at][2])
        if at not in way:
            out.setdefault(tree, []).append([by[x] for x in reversed(way)])
    return out


def trees():
    rng = random.Random(2)
    rows = []
    for tree in [*range(25), None]:
        for node in range(rng.choice([1, 2, 5, 20, 70])):
            parent = None if node == 0 or rng.random() < .03 else rng.randrange(max(0, node - rng.choice([1, 1, 3])), node)
            rows.append((tree, node, parent, rng.choice([None, 0.0, 1.0, rng.random()]), rng.choice(["user", "assistant", "a: b", None]), rng.choice(HARD)))
    rows += [(90, 1, 2, 1.0, "user", "cycle"), (90, 2, 1, 1.0, "user", "cycle"), (90, 3, 2, 1.0, "user", "hangs on it"), (90, 4, 77, 0.0, "user", "lost parent")]
    return rows


def test_best_paths(spark):
    rows = trees()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)
    want = paths(rows)
    for best in (1, None):
        made = chat.conversations(df, best)
        got = {(r.tree, r.leaf): r for r in chat.read(made).collect()}
        masks = {(r.tree, r.leaf): r for r in made.collect()}
        expected = {}
        for tree, ways in want.items():
            ways = sorted(ways, key=lambda w: (-(sum(x[3] or 0 for x in w) / len(w)), w[-1][1]))
            for w in ways[:best]:
                expected[tree, w[-1][1]] = w
        assert got.keys() == expected.keys()
        for key, w in expected.items():
            r = got[key]
            assert [(t.role, t.text) for t in r.turns] == [(x[4] or "", x[5] or "") for x in w]
            assert r.loss_text == "".join(x[5] or "" for x in w if x[4] == "assistant")
            assert masks[key].n_turns == len(w) and r.formatted_chars == len(masks[key].formatted)


def test_ranks(spark):
    rows = [(1, 0, None, 0.0, "user", "q")] + [(1, i, 0, s, "assistant", str(i)) for i, s in ((1, .5), (2, .9), (3, .5), (4, None))]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert [r.leaf for r in chat.conversations(df, None).orderBy("rank").collect()] == [2, 1, 3, 4]
    assert chat.conversations(df.limit(0)).count() == 0


def test_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(HARD)) for c in [*range(20), None] for t in range(rng.randint(1, 9))]
    rows += [(3, 0, "user", "x"), (3, 0, "user", "x"), (50, None, "user", "y")] + [(60, t, "assistant", "z") for t in range(150)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "conv_id long, turn long, role string, text string, node string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    odd = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    order = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")  # noqa: E731  nulls first, then role and text
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=order)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        want[c] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = QUERIES["op4_reply_trees"](spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
