"""Sequence operators against plain loops, whole and cut into slices."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscribe.operators import anchors, dedup, render, scans, sequence as seq
from chronoscribe.operators.runs import Runs
from helpers import at, captures

CUT = dict(rows_per_task=5, slices=6)


def loop_windows(ts, width):
    out, start = [], None
    for t in ts:
        if start is None or t - start >= width:
            start = t
        out.append(start)
    return out


def loop_hybrid(rows, width, minimum):
    """rows: (id, t, app) in order -> id -> chunk id"""
    starts = loop_windows([r[1] for r in rows], width)
    result, i = {}, 0
    while i < len(rows):
        j = i
        while j < len(rows) and starts[j] == starts[i]:
            j += 1
        chunks = []
        for r in rows[i:j]:
            if chunks and chunks[-1][-1][2] == r[2]:
                chunks[-1].append(r)
            else:
                chunks.append([r])
        merged = []
        for c in chunks:
            if merged and minimum > 0 and c[-1][1] - c[0][1] < minimum:
                merged[-1].extend(c)
            else:
                merged.append(list(c))
        for m in merged:
            for r in m:
                result[r[0]] = m[0][0]
        i = j
    return result


def random_rows(seed, n=160, gap=40, devices=("a", "b", None)):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 2, 5, gap])
        rows.append(dict(id=i, t=t, device=rnd.choices(devices, [6, 2, 1])[0], app=rnd.choice("AAB"),
                         type=rnd.choice(["keyframe", "delta", "delta"]), text=rnd.choice("xyz")))
    return rows


def per_device(rows):
    for d in {r["device"] for r in rows}:
        yield sorted((r for r in rows if r["device"] == d), key=lambda r: (r["t"], r["id"]))


@pytest.mark.parametrize("size", [{}, CUT])
@pytest.mark.parametrize("seed,width", [(1, 10), (3, 1000)])
def test_windows_and_hybrid(spark, size, seed, width):
    rows = random_rows(seed)
    df = captures(spark, rows)
    got = {r.id: (r.windowStart, r.chunkId) for r in seq.chunk_hybrid(df, ["device"], width, 4, **size).collect()}
    for part in per_device(rows):
        starts = loop_windows([r["t"] for r in part], width)
        chunks = loop_hybrid([(r["id"], r["t"], r["app"]) for r in part], width, 4)
        for r, s in zip(part, starts):
            assert got[r["id"]] == (at(s).replace(tzinfo=None), chunks[r["id"]])


@pytest.mark.parametrize("size", [{}, CUT])
def test_one_sequence_without_keys(spark, size):
    rows = random_rows(5, n=120)
    got = {r.id: r.chunkId for r in seq.chunk_hybrid(captures(spark, rows), [], 25, 0, **size).collect()}
    order = sorted(rows, key=lambda r: (r["t"], r["id"]))
    assert got == loop_hybrid([(r["id"], r["t"], r["app"]) for r in order], 25, 0)


@pytest.mark.parametrize("gap,windows", [(300, 2), (299.999999, 1), (300.000001, 2)])
def test_window_edge(spark, gap, windows):
    df = captures(spark, [dict(id=1, t=0), dict(id=2, t=gap)])
    assert seq.chunk_by_time(df).select("windowStart").distinct().count() == windows


def test_empty_table(spark):
    df = captures(spark, [])
    assert seq.chunk_hybrid(df, ["device"]).count() == 0
    assert render.format_hierarchical(df, ["device"]).count() == 0


@pytest.mark.parametrize("size", [{}, CUT])
def test_app_switch_and_features(spark, size):
    rows = [dict(id=i, t=i, app=a, title=f"w{i}") for i, a in enumerate("AABBBACC")]
    chunked = seq.chunk_by_app_switch(captures(spark, rows), ["device"], **size)
    assert [r.chunkId for r in chunked.orderBy("id").collect()] == [0, 0, 2, 2, 2, 5, 6, 6]
    mixed = chunked.withColumn("chunkId", F.lit(1))
    f = seq.chunk_features(mixed, ["device"]).first()
    assert (f.primaryApp, f.appNames, f.primaryWindowTitle, f.captureIds) == ("A", ["A", "B", "C"], "w7", list(range(8)))


def test_merge_short_chunks(spark):
    spans = [(0, 1), (10, 40), (50, 51), (52, 53), (60, 90), (95, 95)]
    df = spark.createDataFrame([(i, at(a), at(b)) for i, (a, b) in enumerate(spans)], "chunkId long, startTs timestamp, endTs timestamp")
    for size in ({}, dict(rows_per_task=1, slices=4)):
        got = {r.chunkId: r.mergedId for r in seq.merge_short_chunks(df, [], 15, **size).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {r.mergedId for r in seq.merge_short_chunks(df, [], 0).collect()} == set(range(6))


@pytest.mark.parametrize("size", [{}, CUT])
def test_groups_by_position(spark, size):
    rows = random_rows(7)
    got = {r.id: r for r in seq.group_members(seq.group_captures(captures(spark, rows), ["device"], **size), ["device"], **size).collect()}
    for part in per_device(rows):
        current, n = None, 0
        for r in part:
            if r["type"] == "keyframe":
                current, n = r["id"], 0
            n += 1
            expected = current if current is not None else r["id"]
            assert got[r["id"]].groupId == expected
            assert got[r["id"]].position == (n if current is not None else 1)


@pytest.mark.parametrize("size", [{}, dict(rows_per_task=2, slices=3)])
def test_capture_groups_parents(spark, size):
    rows = [dict(id=1, t=0, type="keyframe"), dict(id=2, t=50, type="delta", parent=99),
            dict(id=3, t=51, type="delta"), dict(id=4, t=52, type="delta", parent=1),
            dict(id=5, t=53, type="delta", parent=99), dict(id=6, t=54, type="keyframe"),
            dict(id=7, t=55, type="delta", parent=1)]
    got = seq.capture_groups(captures(spark, rows), at(50), at(60), ["device"], **size).orderBy("id").collect()
    assert [(r.id, r.groupId, r.parentOutside) for r in got] == [
        (2, 2, False), (3, 3, False), (4, 1, True), (5, 1, True), (6, 6, False), (7, 6, False)]
    assert seq.capture_groups(captures(spark, rows), at(50), at(60), limit=2).count() == 2


@pytest.mark.parametrize("size", [{}, dict(rows_per_task=4, slices=5)])
def test_evenly_spaced(spark, size):
    df = captures(spark, [dict(id=i, t=i) for i in range(16)])
    assert [r.id for r in seq.evenly_spaced(df, 12, **size).orderBy("id").collect()] == [
        int(i * (15 / 11)) for i in range(12)]
    assert [r.id for r in seq.evenly_spaced(df, 1, **size).collect()] == [0]
    assert seq.evenly_spaced(df, 20, **size).count() == 16


@pytest.mark.parametrize("size", [{}, CUT])
def test_dedup_consecutive(spark, size):
    texts = ["A b", " a  B ", "a b", "c", "a b", "a b"]
    df = captures(spark, [dict(id=i, t=i, text=t) for i, t in enumerate(texts * 3)])
    kept = [r.id for r in dedup.dedup_consecutive(df, ["device"], **size).orderBy("id").collect()]
    norm = [" ".join(t.lower().split()) for t in texts * 3]
    assert kept == [i for i, t in enumerate(norm) if i == 0 or norm[i - 1] != t]
    seed = df.filter("id = 0").select("device", F.sha2(F.lit("a b"), 256).alias("textHash"))
    first = dedup.dedup_consecutive(df, ["device"], last=seed, **size).agg(F.min("id")).first()[0]
    assert first == 3


@pytest.mark.parametrize("size", [{}, CUT])
def test_running_columns(spark, size):
    rows = random_rows(11)
    runs = Runs(captures(spark, rows), ["device"], **size)
    runs.previous("prev", F.col("appName")).position("pos").total("n", F.lit(1).cast("long"))
    runs.last_where("kf", F.col("frameType") == "keyframe", F.col("id"))
    got = {r.id: r for r in runs.frame().collect()}
    for part in per_device(rows):
        kf = None
        for i, r in enumerate(part):
            kf = r["id"] if r["type"] == "keyframe" else kf
            g = got[r["id"]]
            assert (g.pos, g.n, g.kf) == (i + 1, len(part), kf)
            assert (g.prev.v if g.prev else None) == (part[i - 1]["app"] if i else None)


def loop_render(part, max_kf, max_d, kf_len, d_len):
    groups = []
    for r in part:
        if r["type"] == "keyframe":
            groups.append([r])
        elif groups and groups[-1][0]["type"] == "keyframe":
            groups[-1].append(r)
        else:
            groups.append([r])

    def sample(xs, k):
        if len(xs) <= k:
            return xs
        return [xs[0]] if k == 1 else [xs[int(i * ((len(xs) - 1) / (k - 1)))] for i in range(k)]

    def short(t, n):
        return t if len(t) <= n else t[:n] + "..."

    out = []
    for g in sample(groups, max_kf):
        out.append(f"--- Keyframe ({at(g[0]['t']):%H:%M:%S}) [{g[0]['app']} — {g[0].get('title') or 'Unknown'}] ---\n{short(g[0]['text'], kf_len)}")
        for r in sample(g[1:], max_d):
            if r["text"]:
                out.append(f"--- Delta ({at(r['t']):%H:%M:%S}) [{int(r['change'] * 100)}% changed] ---\n{short(r['text'], d_len)}")
    return "\n\n".join(out)


@pytest.mark.parametrize("size", [{}, CUT])
@pytest.mark.parametrize("limits", [(4, 2, 5, 3), (3, 1, 9, 9)])
def test_render(spark, size, limits):
    rnd = random.Random(4)
    rows = random_rows(21, n=70)
    for r in rows:
        r.update(text="q" * rnd.choice([0, 2, 3, 5, 8]), change=rnd.random(), title=rnd.choice([None, "T"]))
    got = {r.device: r.text for r in render.format_hierarchical(captures(spark, rows), ["device"], *limits, **size).collect()}
    for part in per_device(rows):
        assert got[part[0]["device"]] == loop_render(part, *limits)


def test_slices_stand_once_in_the_plan(spark):
    """However many columns are chained, the stored slices are scanned once by the result."""
    df = captures(spark, [dict(id=i, t=i * 7 % 500, app="AB"[i % 2], type="keyframe" if i % 5 == 0 else "delta") for i in range(120)]).drop("device")
    counts = []
    for columns in (1, 3, 6):
        runs = Runs(df.select("id", "ts", "appName"), [], cut=True, slices=4)
        for k in range(columns):
            runs.running_sum(f"s{k}", F.lit(1).cast("long"))
        plan = runs.frame()._jdf.queryExecution().executedPlan().toString()
        counts.append(plan.count("Scan ExistingRDD"))
    assert counts[0] == counts[-1]
    hybrid = seq.chunk_hybrid(df, [], 100, 15, cut=True)
    assert hybrid._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 3


@pytest.mark.parametrize("strict", [False, True])
def test_exit_maps_compose(strict):
    """Maps of neighbouring slices, composed in any nesting, lead where the whole sequence leads."""
    rnd = random.Random(int(strict))
    for _ in range(200):
        v = np.sort(np.array([rnd.randrange(60) for _ in range(rnd.randrange(1, 40))], np.int64))
        maps = anchors.ExitMaps(np.int64, rnd.choice([0, 1, 3, 10, 100]), strict)
        cuts = sorted({0, *[rnd.randrange(len(v)) for _ in range(6)], len(v)})
        parts = [maps.of(v[a:b]) for a, b in zip(cuts, cuts[1:])]

        def walk(anchor, values):
            for x in values:
                if anchor is None or x - anchor > maps.width or (not strict and x - anchor == maps.width):
                    anchor = x
            return anchor

        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            parts[i:i + 2] = [maps.combine(*parts[i:i + 2])]
        for anchor in [None, *range(int(v[0]) - 12, int(v[0]) + 1)]:
            assert maps.leave(anchor, parts[0]) == walk(anchor, v)


def test_scan_jobs_grow_with_the_logarithm(spark):
    """Sums as states; the number of jobs is two a level, and no stage puts all summaries into one task."""
    sc = spark.sparkContext

    def scan(n):
        rows = spark.createDataFrame([(k, s, s.to_bytes(8, "little")) for k in ("a", None) for s in range(n)], "key string, slice int, summary binary")
        number = lambda b: int.from_bytes(b, "little")
        group = f"scan-{n}"
        sc.setJobGroup(group, "")
        out = scans.carried(rows, ["key"], "slice", n, lambda a, b: (number(a) + number(b)).to_bytes(8, "little"),
                            lambda s, f: ((number(s) if s is not None else 0) + number(f)).to_bytes(8, "little"))
        got = {(r.key, r.slice): number(r.carry) for r in out.collect()}
        assert got == {(k, s): sum(range(s)) for k in ("a", None) for s in range(1, n)}
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    few, many = scan(10), scan(300)
    assert many <= few + 2 * 2 * 3


def test_no_single_task_over_the_maps(spark):
    """One sequence in many slices: no stage after the slicing reads all of it, and nothing is put into one partition."""
    df = captures(spark, [dict(id=i, t=i) for i in range(400)]).select("id", "ts")
    out = seq.chunk_by_time(df, [], 7, rows_per_task=10, slices=40)
    assert [r.id for r in out.orderBy("id").collect()] == list(range(400))
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert {r.id: r.windowStart for r in out.collect()} == {r.id: r.windowStart for r in seq.chunk_by_time(df, [], 7).collect()}
