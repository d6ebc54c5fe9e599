import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoscribe.operators import frames
from helpers import at


def frame_table(spark, images, stream="s"):
    """images: list of (height, width, 4) arrays"""
    rows = [(stream, at(i), i, im.shape[1], im.shape[0], bytearray(im.tobytes())) for i, im in enumerate(images)]
    return spark.createDataFrame(rows, "stream string, ts timestamp, id long, width int, height int, pixels binary")


def grey(h, w, v, alpha=255):
    im = np.full((h, w, 4), v, np.uint8)
    im[..., 3] = alpha
    return im


def totals(spark, a, b, **size):
    got = frames.tile_diff(frame_table(spark, [a, b]), **size).filter("id = 1").collect()
    return {(r.row, r.col): (r.total, r.changed) for r in got}


def test_tile_sums(spark):
    assert set(totals(spark, grey(64, 64, 128), grey(64, 64, 128)).values()) == {(0, False)}
    assert totals(spark, grey(32, 32, 0), grey(32, 32, 255)) == {(0, 0): (783_360, True)}
    assert totals(spark, grey(32, 32, 9, 0), grey(32, 32, 9, 255)) == {(0, 0): (0, False)}
    dot = grey(32, 32, 0)
    dot[5, 5, :3] = (10, 20, 30)
    assert totals(spark, grey(32, 32, 0), dot) == {(0, 0): (60, False)}
    moved = grey(128, 128, 100)
    moved[32:64, 32:64, :3] = 200
    got = totals(spark, grey(128, 128, 100), moved)
    assert got[(1, 1)] == (307_200, True) and sum(v[0] for v in got.values()) == 307_200
    assert totals(spark, grey(5, 7, 50), grey(5, 7, 100)) == {(0, 0): (5_250, True)}


@pytest.mark.parametrize("size", [{}, dict(rows_per_task=3, slices=4)])
def test_pseudo_random_tiles(spark, size):
    n = np.arange(100 * 70 * 4)
    a = ((7 * n + 13) ^ (n >> 3)).astype(np.uint8).reshape(70, 100, 4)
    b = ((11 * n + 37) ^ (n >> 2)).astype(np.uint8).reshape(70, 100, 4)
    for (r, c), (total, _) in totals(spark, a, b, **size).items():
        part = (slice(32 * r, 32 * r + 32), slice(32 * c, 32 * c + 32), slice(0, 3))
        assert total == int(np.abs(a[part].astype(int) - b[part].astype(int)).sum())


def test_noise_threshold_is_strict(spark):
    allowance = int(10 / 255 * 255.0 * 1024 * 3)
    df = spark.createDataFrame([(allowance,), (allowance + 1,)], "t long")
    got = df.select(frames.tile_changed(F.col("t"), F.lit(32), F.lit(32)).alias("c")).collect()
    assert [r.c for r in got] == [False, True]


def test_size_change_and_fraction(spark):
    images = [grey(64, 64, 1), grey(32, 64, 1), grey(64, 64, 1), grey(64, 64, 1)]
    images[3][:32, :, :3] = 200
    tiles = frames.tile_diff(frame_table(spark, images))
    got = {r.id: (r.tiles, r.changedFraction, r.significant) for r in frames.change_fraction(tiles).collect()}
    # Frame 2 has the size of frame 0, yet the frame before it has another one.
    assert got == {0: (4, 1.0, True), 1: (2, 1.0, True), 2: (4, 1.0, True), 3: (4, 0.5, True)}


def test_components(spark):
    rows = [("s", 1, r, c, True, 200, 150) for r, c in [(0, 0), (1, 1), (2, 4), (3, 4), (4, 4)]] + [("s", 1, 3, 0, False, 200, 150)]
    tiles = spark.createDataFrame(rows, "stream string, id long, row int, col int, changed boolean, width int, height int")
    got = {(r.x, r.y, r.width, r.height) for r in frames.merge_changed_tiles(tiles).collect()}
    assert got == {(0, 0, 64, 64), (0, 0, 96, 96), (96, 32, 96, 118)}


@pytest.mark.parametrize("size", [{}, dict(rows_per_task=2, slices=3)])
def test_reading_order(spark, size):
    rows = [(1, 0, 0.90, 0.5, "b"), (1, 1, 0.915, 0.7, "c"), (1, 2, 0.905, 0.1, "a"), (1, 3, 0.88, 0.0, "d"), (1, 4, 0.862, 0.4, "e"),
            (1, 5, 0.845, 0.1, "f"), (2, 6, 0.1, 0.1, "x")]
    df = spark.createDataFrame(rows, "frame_id long, region_id long, y double, x double, text string")
    got = {r.frame_id: r.text for r in frames.reading_order_text(df, **size).collect()}
    assert got == {1: "a\nb\nc\nd\ne\nf", 2: "x"}


def test_fallback_and_crop(spark):
    f = spark.createDataFrame([(1,), (2,), (3,)], "frame_id long")
    regions = spark.createDataFrame([(1,)] * 8 + [(2,)] * 9, "frame_id long")
    got = {r.frame_id: r.mode for r in frames.regions_fallback(f, regions).collect()}
    assert got == {1: "regions", 2: "full", 3: "none"}
    box = spark.createDataFrame([((0.5, 0.25, 0.1, 0.2), (100.0, 50.0, 200.0, 100.0), 1000, 500)],
                                "bounds struct<x:double,y:double,width:double,height:double>, crop struct<x:double,y:double,width:double,height:double>, full_width int, full_height int")
    assert tuple(frames.crop_to_full_coords(box).first().bounds) == pytest.approx((0.2, 0.15, 0.02, 0.04))
    assert frames.crop_to_full_coords(box, origin="bottom_left").first().bounds.y == pytest.approx((350 + 25) / 500)


def test_boxes_of_many_grids():
    """Random grids of several frames at once against a flood fill."""
    rnd = np.random.default_rng(7)
    for share in (0.1, 0.4, 0.6, 0.9):
        grids = [rnd.random((rnd.integers(1, 12), rnd.integers(1, 12))) < share for _ in range(30)] + [np.zeros((3, 3), bool)]
        cells = pa.array([[{"row": int(r), "col": int(c)} for r, c in np.argwhere(g)] for g in grids], pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32())])))
        want = []
        for f, g in enumerate(grids):
            left = {tuple(x) for x in np.argwhere(g).tolist()}
            for start in sorted(left):
                if start not in left:
                    continue
                group, todo = [], [start]
                left.discard(start)
                while todo:
                    r, c = todo.pop()
                    group.append((r, c))
                    near = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & left
                    left -= near
                    todo += near
                rs, cs = zip(*group)
                want.append((f, min(cs), min(rs), max(cs), max(rs)))
        assert list(zip(*[v.tolist() for v in frames.boxes(cells)])) == want


def test_tiles_of_any_size(spark):
    """Frames of several sizes in one batch, with smaller tiles at the edges, give the bytes of each tile."""
    rnd = np.random.default_rng(2)
    images = [rnd.integers(0, 256, (h, w, 4), dtype=np.uint8) for h, w in ((5, 7), (5, 7), (4, 4), (1, 9), (8, 3), (5, 7))]
    got = {(r.id, r.row, r.col): (r.tileWidth, r.tileHeight, bytes(r.bytes)) for r in frames.cut_tiles(frame_table(spark, images), 4).collect()}
    want = {}
    for i, im in enumerate(images):
        for y in range(0, im.shape[0], 4):
            for x in range(0, im.shape[1], 4):
                part = im[y:y + 4, x:x + 4, :3]
                want[i, y // 4, x // 4] = (part.shape[1], part.shape[0], part.tobytes())
    assert got == want


def test_shuffled_bytes_fall_with_equal_tiles(spark):
    """What the comparison sends is the changed tiles and those before them."""
    still = grey(128, 128, 9)
    moved = still.copy()
    moved[:32, :32, :3] = 77
    rows = frames.tile_diff(frame_table(spark, [still, still, moved, moved, still])).collect()
    assert sorted((r.id, r.row, r.col) for r in rows if r.total) == [(2, 0, 0), (4, 0, 0)]
    assert all(r.total == 0 for r in rows if r.id in (1, 3)) and all(r.total is None and r.changed for r in rows if r.id == 0)
    written = lambda images: shuffled(spark, lambda: frames.tile_diff(frame_table(spark, images)).collect())
    noise = [np.random.default_rng(i).integers(0, 256, (256, 256, 4), dtype=np.uint8) for i in range(6)]
    quiet = [noise[0]] * 6
    assert written(quiet) < written(noise) / 10


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write for shuffles."""
    sc, group = spark.sparkContext, f"group-{uuid.uuid4()}"
    sc.setJobGroup(group, "")
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
