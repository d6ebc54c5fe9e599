"""Frame machine: cases, slices, restored state, stream against batch."""
import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe import schema as S
from chronoscribe.operators import dedup
from chronoscribe.streaming import capture, chunks, machine
from chronoscribe.operators import sequence as seq
from helpers import at, captures


def observations(spark, rows):
    return spark.createDataFrame(
        [(r.get("device", "d"), i, at(r["t"]), r.get("app", "A"), None, r.get("change", 0.1), r["full"], r.get("delta", "")) for i, r in enumerate(rows)],
        S.OBSERVATIONS)


def run(spark, rows, **k):
    got = machine.classify_frames(observations(spark, rows), **k).orderBy("id").collect()
    return [(r.decision, r.reason, r.stored) for r in got], got


def test_decisions(spark):
    rows = [dict(t=0, full="a", change=0.0), dict(t=2, full="b", change=0.0), dict(t=4, full="b", delta="x", change=0.499),
            dict(t=6, full="c", change=0.5), dict(t=8, full="d", app="B", change=0.01), dict(t=67, full="e", app="B", delta="y", change=0.01),
            dict(t=68, full="f", app="B", change=0.01)]
    flags, got = run(spark, rows)
    assert flags == [("keyframe", "first", True), ("skip", "unchanged", False), ("delta", "change", True), ("keyframe", "change", True),
                     ("keyframe", "app", True), ("delta", "change", True), ("keyframe", "time", True)]
    assert got[0].changePercentage == 1.0 and got[2].fullOcrText == "a\nx" and got[2].keyframeId == 0 and got[2].ocrText == "x"


def test_duplicate_keyframe_keeps_the_old_keyframe(spark):
    rows = [dict(t=0, full="a"), dict(t=2, full=" A ", app="B"), dict(t=4, full="a b", app="B", delta="b"),
            dict(t=6, full="q", app="B", delta=" "), dict(t=8, full="q", app="B", delta="z")]
    flags, got = run(spark, rows)
    assert flags == [("keyframe", "first", True), ("keyframe", "app", False), ("keyframe", "app", True), ("delta", "change", False), ("delta", "change", True)]
    # A keyframe equal to "keyframe + delta" is a duplicate too.
    flags, _ = run(spark, [dict(t=0, full="a"), dict(t=1, full="-", delta="b"), dict(t=2, full="A B", change=0.9), dict(t=3, full="a", change=0.9)])
    assert [f[2] for f in flags] == [True, True, False, True]


def test_restored_state(spark):
    stored = captures(spark, [dict(id=7, t=-100, text="a", hash="x"), dict(id=8, t=-30, text="k", hash="old", app="A"),
                              dict(id=9, t=-10, type="delta", hash=__import__("hashlib").sha256(b"b").hexdigest())])
    state = machine.restore_state(stored, ["device"])
    rows = [dict(t=0, full="b"), dict(t=2, full="n", delta="dd"), dict(t=31, full="n")]
    flags, got = run(spark, rows, restored=state)
    assert flags == [("keyframe", "first", False), ("delta", "change", True), ("keyframe", "time", True)]
    assert (got[1].keyframeId, got[1].fullOcrText) == (8, "k\ndd")


def random_observations(seed, n=150, devices="ab"):
    rnd, t, rows = random.Random(seed), 0, []
    for _ in range(n):
        t += rnd.choice([1, 2, 5, 30, 70])
        rows.append(dict(t=t, device=rnd.choice(devices), app=rnd.choice("AAAB"), change=rnd.choice([0.0, .1, .2, .6]),
                         full=rnd.choice("xyz"), delta=rnd.choice(["", "p", "q"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_equal_whole(spark, seed):
    obs = observations(spark, random_observations(seed))
    whole = machine.classify_frames(obs)
    cut = machine.classify_frames(obs, rows_per_task=10, slices=9)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0
    out = machine.materialize_frames(obs)
    assert out.count() == whole.filter("stored").count()
    # Nothing stored repeats the text stored before it.
    assert dedup.dedup_consecutive(out, ["device"]).count() == out.count()


def observed(rows):
    """Rows as the machine sees them."""
    fields = ["id", "us", "appName", "changedFraction", "fullText", "fullNorm", "changedText", "changedNorm"]
    Row = collections.namedtuple("Row", fields)
    return [Row(i, int(r["t"] * 1e6), r["app"], r["change"], r["full"], r["full"], r["delta"], r["delta"]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", range(6))
def test_slices_compose(seed):
    """A sequence cut anywhere and composed in any nesting leaves the state of the whole, whatever it inherits."""
    rnd = random.Random(seed)
    for _ in range(60):
        rows = observed(random_observations(rnd.random(), rnd.randrange(1, 40), "a"))
        cap = rnd.choice([1, 60, 200]) * 1_000_000
        cuts = sorted({0, *[rnd.randrange(len(rows)) for _ in range(5)], len(rows)})
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            part = machine.Slice(0.5, cap)
            for row in rows[a:b]:
                part.add(row)
            parts.append(part.summary())
        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            parts[i:i + 2] = [machine.compose(*parts[i:i + 2], 0.5, cap)]
        digest = machine._hash
        inherited = [machine.State(seen, last, -1, text, text, app, us) for seen in (True, False) for last in (None, digest("x"), digest("x p"))
                     for text in ("x", "y") for app in "AB" for us in (None, -1_000_000, -50_000_000)]
        for state in [None, *inherited]:
            want = state or machine.State()
            for row in rows:
                want, _ = machine.step(want, row, 0.5, cap)
            assert machine.leave(state, parts[0], 0.5, cap) == want


def test_frames_of_one_long_sequence(spark):
    """Many slices of one device: no driver loop over them, and nothing in one partition."""
    obs = observations(spark, random_observations(5, 400, "a"))
    sc = spark.sparkContext
    sc.setJobGroup("frames", "")
    cut = machine.classify_frames(obs, rows_per_task=10, slices=40)
    jobs = len(sc.statusTracker().getJobIdsForGroup("frames"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 20 and "SinglePartition" not in cut._jdf.queryExecution().toString()
    whole = machine.classify_frames(obs)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_slices_of_restored_keys(spark):
    stored = captures(spark, [dict(id=7000 + i, t=-30, text="k", hash="old", app="A", device=d) for i, d in enumerate("ab")])
    obs = observations(spark, random_observations(8, 80))
    state = machine.restore_state(stored, ["device"])
    whole = machine.classify_frames(obs, restored=state).collect()
    cut = machine.classify_frames(obs, restored=state, rows_per_task=5, slices=12).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, cut)) and len(whole) == 80


def write_batches(df, folder, parts):
    for i in range(parts):
        df.filter(F.floor(F.col("id") * parts / 150) == i).coalesce(1).write.mode("append").parquet(folder)


def drain(stream, name, folder):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", folder).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    obs = observations(spark, random_observations(3))
    folder = str(tmp_path / "in")
    write_batches(obs, folder, 4)
    stream = capture.stream_captures(spark, folder, max_files=1)
    drain(capture.classify_frames_stream(stream), "frames", str(tmp_path / "cp"))
    batch = machine.classify_frames(obs)
    got = spark.table("frames").select(*batch.columns)
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_stream_from_restored_state(spark, tmp_path):
    stored = captures(spark, [dict(id=8, t=-30, text="k", hash="old", app="A")])
    obs = observations(spark, [dict(t=0, full="b"), dict(t=2, full="n", delta="dd")])
    folder = str(tmp_path / "in")
    obs.coalesce(1).write.parquet(folder)
    stream = capture.stream_captures(spark, folder)
    drain(capture.classify_frames_stream(stream, restored=machine.restore_state(stored, ["device"])), "restored", str(tmp_path / "cp"))
    assert {(r.id, r.decision, r.keyframeId) for r in spark.table("restored").collect()} == {(0, "keyframe", None), (1, "delta", 0)}


def test_dedup_stream(spark, tmp_path):
    rows = [dict(id=i, t=i, device="ab"[i % 2], text=random.Random(i).choice("xy")) for i in range(150)]
    df = captures(spark, rows).drop("textHash")
    folder = str(tmp_path / "in")
    write_batches(df, folder, 3)
    stream = capture.stream_captures(spark, folder, df.schema, max_files=1)
    drain(capture.dedup_consecutive_stream(stream), "deduped", str(tmp_path / "cp"))
    expected = {r.id for r in dedup.dedup_consecutive(df, ["device"]).collect()}
    assert {r.id for r in spark.table("deduped").collect()} == expected
    drain(capture.dedup_within(stream, "1 hour"), "within", str(tmp_path / "cp2"))
    assert spark.table("within").count() == 4


def test_window_stream(spark, tmp_path):
    rnd, t, rows = random.Random(9), 0, []
    for i in range(150):
        t += rnd.choice([1, 20, 90])
        rows.append(dict(id=i, t=t, device=rnd.choice("ab")))
    df = captures(spark, rows)
    folder = str(tmp_path / "in")
    write_batches(df, folder, 5)
    # A far row moves the watermark past all others.
    captures(spark, [dict(id=9999, t=t + 10_000, device="z")]).coalesce(1).write.mode("append").parquet(folder)
    stream = capture.stream_captures(spark, folder, df.schema, max_files=1)
    drain(chunks.chunk_by_time_stream(stream, window=120, delay="300 seconds"), "windows", str(tmp_path / "cp"))
    got = {r.id: (r.windowStart, r.late) for r in spark.table("windows").filter("device <> 'z'").collect()}
    expected = {r.id: (r.windowStart, False) for r in seq.chunk_by_time(df, ["device"], 120).collect()}
    assert got == expected


class Store:
    """States of one key in memory, and how many entries were read, written and removed."""

    def __init__(self):
        self.maps, self.values, self.timers, self.touched = {}, {}, set(), []

    def getMapState(self, name, *_):
        store, held = self, self.maps.setdefault(name, {})

        class Map:
            def containsKey(self, k):
                return k in held

            def getValue(self, k):
                store.touched.append(("get", name, k))
                return held[k]

            def updateValue(self, k, v):
                store.touched.append(("put", name, k))
                held[k] = v

            def removeKey(self, k):
                store.touched.append(("remove", name, k))
                del held[k]

        return Map()

    def getValueState(self, name, *_):
        values = self.values

        class Value:
            def exists(self):
                return name in values

            def get(self):
                return values[name]

            def update(self, v):
                values[name] = v

            def clear(self):
                del values[name]

        return Value()

    def registerTimer(self, ms):
        self.timers.add(ms)


def batch(processor, store, rows, watermark_ms):
    """One micro-batch for one key: its rows, then the timers that the watermark has passed; what comes out."""
    class Now:
        def getCurrentWatermarkInMs(self):
            return watermark_ms

    class Timer:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    out = []
    if rows:
        out += list(processor.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["us", "id", "appName"])]), Now()))
    for ms in sorted(t for t in store.timers if t <= watermark_ms):
        store.timers.discard(ms)
        out += list(processor.handleExpiredTimer(("k",), Now(), Timer(ms)))
    return [r for frame in out for r in frame[["id", "windowStart", "late"]].itertuples(index=False)]


def anchor_processor(bucket_ms=1000, window_us=3_000_000):
    row = T.StructType([T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("appName", T.StringType())])
    processor, store = chunks.AnchorProcessor(row, bucket_ms, window_us, "device"), Store()
    processor.init(store)
    return processor, store


def test_a_batch_touches_only_its_own_buckets():
    processor, store = anchor_processor()
    batch(processor, store, [(i * 1_000_000, i, "a") for i in range(500)], 0)
    assert len(store.maps["chunks"]) == 500
    store.touched.clear()
    # Five rows for two of five hundred waiting buckets, and the watermark passes three.
    batch(processor, store, [(400_000_000 + i, 1000 + i, None) for i in range(4)] + [(2_500_000, 2000, "b")], 0)
    assert sorted({k[0] for _, _, k in store.touched}) == [2, 400] and len(store.touched) == 6
    assert not [t for t in store.touched if t[:2] == ("get", "chunks")]
    store.touched.clear()
    out = batch(processor, store, [], 3000)
    assert [r.id for r in out] == [0, 1, 2, 2000] and {k[0] for _, _, k in store.touched} == {0, 1, 2}
    assert len(store.maps["chunks"]) == 502 - 4 and len(store.maps["counts"]) == 497


def test_late_rows_and_forgotten_starts():
    processor, store = anchor_processor()
    assert batch(processor, store, [(500_000, 1, "a"), (100_000, 0, "a"), (3_200_000, 2, "a"), (9_000_000, 3, "a")], 0) == []
    out = batch(processor, store, [], 4000)
    assert [(r.id, r.windowStart.microsecond // 1000 + 1000 * r.windowStart.second, r.late) for r in out] == [(0, 100, False), (1, 100, False), (2, 3200, False)]
    # The bucket of 3.9 s has ended, that of 4.0 s has not.
    out = batch(processor, store, [(3_900_000, 4, None), (4_000_000, 5, "a")], 4500)
    assert [(r.id, r.late) for r in out] == [(4, True)] and pd.isna(out[0].windowStart)
    assert [r.id for r in batch(processor, store, [], 5000)] == [5] and "mark" in store.values
    batch(processor, store, [], 8000)
    assert "mark" not in store.values and not store.maps["counts"].get((4,))
    out = batch(processor, store, [], 10_000)
    assert [(r.id, r.windowStart.second) for r in out] == [(3, 9)]


@pytest.mark.parametrize("seed", range(4))
def test_any_order_of_arrival(seed):
    rnd = random.Random(seed)
    processor, store = anchor_processor(bucket_ms=rnd.choice([1, 700, 5000]))
    rows = [(rnd.randrange(60_000_000), i, "a") for i in range(300)]
    out, left = [], list(rows)
    for _ in range(10):
        # The watermark is where no row that is still to come lies before it.
        watermark = min(r[0] for r in left) // 1000
        out += batch(processor, store, [left.pop(rnd.randrange(len(left))) for _ in range(30)], watermark)
    out += batch(processor, store, [], 10**7)
    anchor, want = None, []
    for us, i, _ in sorted(rows):
        anchor = us if anchor is None or us - anchor >= 3_000_000 else anchor
        want.append((i, anchor))
    assert [(r.id, int(r.windowStart.value // 1000)) for r in out] == want and not any(r.late for r in out)
    assert not store.maps["chunks"] and not store.maps["counts"]


def in_turn(spark, parts, transform, name, folder):
    """Rows of a stream that gets ``parts`` one after the other, each drained before the next."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = transform(capture.stream_captures(spark, f"{folder}/in", part.schema))
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_late_rows_of_a_stream(spark, tmp_path):
    rows = captures(spark, [dict(id=i, t=60 * i, device="ab"[i % 2]) for i in range(60)]).select("id", "ts", "device", "appName")
    second = captures(spark, [dict(id=100, t=61, device="a"), dict(id=101, t=3300, device="a"), dict(id=102, t=0, device="c")]).select(*rows.columns)
    end = captures(spark, [dict(id=999, t=100_000, device="z")]).select(*rows.columns)
    out = in_turn(spark, [rows, second, end], lambda s: chunks.chunk_by_time_stream(s, window=600, delay="600 seconds", bucket="60 seconds"), "late", str(tmp_path))
    got = {r.id: r for r in out.collect()}
    # The watermark after the first batch is 2,940 seconds, in the span of its rows.
    assert {i for i, r in got.items() if r.late} == {100, 102} and got[100].windowStart is None
    kept = rows.unionByName(second.filter("id = 101"))
    want = {r.id: r.windowStart for r in seq.chunk_by_time(kept, ["device"], 600).collect()}
    assert {i: r.windowStart for i, r in got.items() if not r.late} == want


def test_streams_in_a_plain_session(spark, tmp_path):
    """The state store that the processors need is chosen where they are used, not by the session's maker."""
    plain = spark.newSession()
    plain.conf.unset("spark.sql.streaming.stateStore.providerClass")
    plain.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    rows = captures(plain, [dict(id=i, t=i, text="xxyyx"[i]) for i in range(5)]).drop("textHash")
    far = captures(plain, [dict(id=99, t=10**6, device="z")]).drop("textHash")
    arriving = [rows.filter("id IN (1, 4)"), rows.filter("id IN (0, 2, 3)"), far]
    out = in_turn(plain, arriving, lambda s: capture.dedup_consecutive_stream(s, delay="10 days", bucket="1 second"), "plain", str(tmp_path))
    assert out.columns == [*rows.columns, "textHash"]
    assert sorted(r.id for r in out.collect()) == [0, 2, 4]
    now = capture.dedup_consecutive_stream(capture.stream_captures(plain, str(tmp_path / "in"), rows.schema))
    drain(now, "at_once", str(tmp_path / "cp2"))


def test_tail_stream(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    rows = captures(spark, [dict(id=i, t=i) for i in range(6)])
    show = lambda df, epoch: seen.append(sorted(r.id for r in df.collect()))
    for part in ("id < 2", "id >= 2 AND id < 5", "id = 5"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(folder)
        capture.tail_stream(capture.stream_captures(spark, folder, rows.schema), show, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert [s for s in seen if s] == [[0, 1], [2, 3, 4], [5]]
