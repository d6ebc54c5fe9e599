"""Tile differences between consecutive frames, changed regions, text layout."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from chronoscribe.operators.anchors import mark_anchors
from chronoscribe.operators.runs import Runs
from chronoscribe.session import stored

# Tile edge, padding of regions, share of noise, share that makes a frame new.
TILE, PADDING, NOISE, SIGNIFICANT = 32, 32, 10.0 / 255.0, 0.50
MAX_REGIONS = 8

_PLACE = [T.StructField(n, T.IntegerType()) for n in ("width", "height", "row", "col", "tileWidth", "tileHeight")]
_TILES = T.StructType([T.StructField("stream", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("id", T.LongType()),
                       *_PLACE, T.StructField("bytes", T.BinaryType())])
_DIGESTS = T.StructType([*[f for f in _TILES.fields if f.name not in ("ts", "bytes")], T.StructField("digest", T.BinaryType())])
#: Bytes of pixels that are cut at a time.
_PIXELS = 8 << 20


def _cells(images: np.ndarray, tile: int) -> Iterator[tuple]:
    """Tiles of images of one size, (images, height, width, 4): (image, row, column, width, height, bytes) by areas in which all
    tiles have one size."""
    n, h, w, _ = images.shape
    for y, th, ny in ((0, tile, h // tile), (h - h % tile, h % tile, 1)):
        for x, tw, nx in ((0, tile, w // tile), (w - w % tile, w % tile, 1)):
            if n and th and tw and ny and nx:
                area = images[:, y:y + ny * th, x:x + nx * tw, :3].reshape(n, ny, th, nx, tw, 3).transpose(0, 1, 3, 2, 4, 5)
                image, row, col = np.unravel_index(np.arange(n * ny * nx), (n, ny, nx))
                yield image, row + y // tile, col + x // tile, tw, th, np.ascontiguousarray(area).reshape(n * ny * nx, th * tw * 3)


def _cut(frames: DataFrame, tile: int, schema: T.StructType, last) -> DataFrame:
    """Rows of ``schema``, whose last column ``last`` makes from the bytes of tiles."""
    names = schema.fieldNames()

    def column(like: pa.RecordBatch, name: str, pick: np.ndarray) -> pa.Array:
        return like.column(like.schema.get_field_index(name)).take(pa.array(pick))

    def made(batch: pa.RecordBatch, width: int, height: int) -> Iterator[pa.RecordBatch]:
        pixels = batch.column(batch.schema.get_field_index("pixels"))
        images = np.frombuffer(b"".join(pixels.to_pylist()), np.uint8).reshape(-1, height, width, 4)
        for image, row, col, tw, th, data in _cells(images, tile):
            n = len(image)
            own = {"width": width, "height": height, "tileWidth": tw, "tileHeight": th}
            arrays = [pa.array(np.full(n, own[c], np.int32)) if c in own else pa.array({"row": row, "col": col}[c].astype(np.int32)) if c in ("row", "col")
                      else column(batch, c, image) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*arrays, last(data)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("width", "height")]
            at = 0
            while at < batch.num_rows:
                # Frames of one size together, many small ones or one large one.
                w, h = int(size[0][at]), int(size[1][at])
                most = at + max(1, _PIXELS // max(1, 4 * w * h))
                other = np.flatnonzero((size[0][at:most] != w) | (size[1][at:most] != h))
                to = at + int(other[0]) if len(other) else min(most, batch.num_rows)
                yield from made(batch.slice(at, to - at), w, h)
                at = to

    return frames.select("stream", "ts", "id", "width", "height", "pixels").mapInArrow(cut, schema)


def _binaries(data: np.ndarray) -> pa.Array:
    n, size = data.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(data)])


def _hashes(data: np.ndarray) -> pa.Array:
    return pa.array([hashlib.blake2b(tile, digest_size=16).digest() for tile in data], pa.binary())


def cut_tiles(frames: DataFrame, tile: int = TILE) -> DataFrame:
    """Frames ``(stream, ts, id, width, height, pixels)`` of BGRA bytes to one row per tile."""
    return _cut(frames, tile, _TILES, _binaries)


def tile_digests(frames: DataFrame, tile: int = TILE) -> DataFrame:
    """As ``cut_tiles``, with a 128-bit digest instead of the bytes."""
    return _cut(frames, tile, _DIGESTS, _hashes)


@arrow_udf(T.LongType())
def byte_difference(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sum of absolute differences of two byte strings; null when one is missing or longer."""
    size = [np.array([-1 if v is None else v for v in pc.binary_length(c).to_pylist()], np.int64) for c in (a, b)]
    good = (size[0] == size[1]) & (size[0] >= 0)
    # The bytes of all comparable pairs, one after the other.
    pick = pa.array(np.flatnonzero(good))
    x, y = (np.frombuffer(b"".join(c.take(pick).to_pylist()), np.uint8).astype(np.int16) for c in (a, b))
    ends = np.concatenate([[0], np.cumsum(size[0][good])])
    running = np.concatenate([[0], np.cumsum(np.abs(x - y), dtype=np.int64)])
    out = np.zeros(len(good), np.int64)
    out[good] = running[ends[1:]] - running[ends[:-1]]
    return pa.array(out, pa.int64(), mask=~good)


def tile_threshold(width: str | Column, height: str | Column, noise: float = NOISE) -> Column:
    w, h = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    return (F.lit(noise * 255.0) * (w * h * 3).cast("double")).cast("long")


def tile_changed(total: Column, width: str | Column, height: str | Column, noise: float = NOISE) -> Column:
    """The difference is strictly above the noise allowance of the tile."""
    return total > tile_threshold(width, height, noise)


def tile_diff(frames: DataFrame, noise: float = NOISE, tile: int = TILE, **size) -> DataFrame:
    """One row per tile of every frame: ``total`` difference to the frame before it in the stream
    and ``changed``. Without such a frame, or with one of another size, every tile is changed.

    Digests travel first, by frame and place; a tile whose digest is that of the tile before it differs in nothing. Only the others,
    and the tiles before them, send their bytes, so what is shuffled falls with the share of tiles that stay as they are.
    """
    order = Runs(frames.select("stream", "ts", "id"), ["stream"], **size).previous("__p", F.col("id"))
    prior = order.frame().select("id", "ts", F.col("__p.v").alias("previousId"))
    now = tile_digests(frames, tile).join(prior, "id")
    before = now.select(F.col("id").alias("previousId"), "row", "col", F.col("width").alias("__w"), F.col("height").alias("__h"), F.col("digest").alias("__d"))
    same_size = (F.col("__w") == F.col("width")) & (F.col("__h") == F.col("height"))
    met = stored(now.join(before, ["previousId", "row", "col"], "left").select(
        "stream", "ts", "id", *[f.name for f in _PLACE], "previousId",
        F.when(same_size, F.col("digest") == F.col("__d")).alias("__same")))
    differ = met.filter("NOT __same").select("id", "previousId", "row", "col")
    wanted = stored(differ.select("id", "row", "col").union(differ.select("previousId", "row", "col")).distinct())
    sent = cut_tiles(frames, tile).select("id", "row", "col", "bytes").join(wanted, ["id", "row", "col"], "left_semi")
    old = sent.select(F.col("id").alias("previousId"), "row", "col", F.col("bytes").alias("__old"))
    sums = (differ.join(sent, ["id", "row", "col"]).join(old, ["previousId", "row", "col"])
            .select("id", "row", "col", byte_difference("bytes", "__old").alias("__sum")))
    total = F.when(F.col("__same"), F.lit(0).cast("long")).otherwise(F.col("__sum"))
    return (met.join(sums, ["id", "row", "col"], "left").withColumn("total", total)
            .withColumn("changed", F.coalesce(tile_changed(F.col("total"), "tileWidth", "tileHeight", noise), F.lit(True)))
            .drop("__same", "__sum"))


def array_tile_diff(df: DataFrame, values: str, keys: list[str], scale: float = 1.0, **size) -> DataFrame:
    """Tile sums for tables that hold each tile as an array of numbers; JVM only."""
    runs = Runs(df, keys, **size).previous("__prev", F.col(values))
    pairs = F.zip_with(F.col(values), F.col("__prev.v"), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) * F.lit(float(scale))
    return runs.with_column("total", total).drop("__prev").frame()


def change_fraction(tiles: DataFrame, keys: list[str] = ("stream", "id"),
                    significant: float = SIGNIFICANT) -> DataFrame:
    """Share of changed tiles per frame and whether it makes the frame a new keyframe."""
    return (tiles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("changed")).alias("changedTiles"))
        .withColumn("changedFraction", F.col("changedTiles") / F.col("tiles"))
        .withColumn("significant", F.col("changedFraction") >= F.lit(float(significant))))


def boxes(cells: pa.Array) -> tuple[np.ndarray, ...]:
    """(frame, left, top, right, bottom) of the 4-connected groups of cells (row, col), which are sorted within each frame; groups in the
    order of their first cells. Cells of a row that touch are one run; runs of neighbouring rows that overlap are one group."""
    n = len(cells)
    flat = cells.flatten()
    frame = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
    row, col = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
    if not len(row):
        return (np.zeros(0, np.int64),) * 5
    # One grid of all frames, with an empty row between them.
    line, span = frame * (row.max() + 2) + row, col.max() + 2
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (col[1:] != col[:-1] + 1)))
    last = np.append(first[1:], len(row)) - 1
    start, end = line[first] * span + col[first], line[last] * span + col[last]
    # Runs in the row below that overlap a run: a stretch of all runs.
    low, high = np.searchsorted(end, start + span), np.searchsorted(start, end + span, "right")
    count = np.maximum(0, high - low)
    a = np.repeat(np.arange(len(start)), count)
    b = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    group = np.arange(len(start))
    while True:
        before = group.copy()
        least = np.minimum(group[a], group[b])
        np.minimum.at(group, group[a], least)
        np.minimum.at(group, group[b], least)
        group = group[group]
        if (group == before).all():
            break
    names, of = np.unique(group, return_inverse=True)
    box = [np.full(len(names), 1 << 62, np.int64), np.full(len(names), 1 << 62, np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)]
    for at, pick, values in ((0, np.minimum, col[first]), (1, np.minimum, row[first]), (2, np.maximum, col[last]), (3, np.maximum, row[first])):
        pick.at(box[at], of, values)
    return frame[first[names]], *box


_RECTS = "array<struct<x:int,y:int,width:int,height:int>>"


def merge_changed_tiles(tiles: DataFrame, tile: int = TILE, padding: int = PADDING) -> DataFrame:
    """Rectangles around the 4-connected groups of changed tiles of each frame, padded and clamped.

    A frame's grid is bounded by the image size, so its tiles fit in one array."""

    @arrow_udf(_RECTS)
    def rectangles(cells: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        frame, x0, y0, x1, y1 = boxes(cells)
        w, h = (c.to_numpy()[frame] for c in (width, height))
        left, top = np.maximum(0, x0 * tile - padding), np.maximum(0, y0 * tile - padding)
        right, bottom = np.minimum(w, (x1 + 1) * tile + padding), np.minimum(h, (y1 + 1) * tile + padding)
        rects = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (left, top, right - left, bottom - top)], ["x", "y", "width", "height"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(frame, np.arange(len(cells) + 1)).astype(np.int32)), rects)

    cells = tiles.filter("changed").groupBy("stream", "id").agg(
        F.sort_array(F.collect_list(F.struct("row", "col"))).alias("cells"),
        F.first("width").alias("width"), F.first("height").alias("height"))
    return cells.select("stream", "id", F.posexplode(rectangles("cells", "width", "height")).alias("region", "r")) \
        .select("stream", "id", "region", "r.*")


# -- regions of recognised text ---------------------------------------------


def reading_order(regions: DataFrame, frame: str = "frame_id", id: str = "region_id", tolerance: float = 0.02,
                  **size) -> DataFrame:
    """Add ``line``: negated y of the line's first region. ``y`` grows upwards; a region more than
    ``tolerance`` below the first region of a line begins the next line."""
    runs = Runs(regions.withColumn("__down", -F.col("y")), [frame], ts="__down", id=id, **size)
    mark_anchors(runs, "__down", tolerance, "line", strict=True)
    return runs.drop("__down").frame()


def reading_order_text(regions: DataFrame, frame: str = "frame_id", id: str = "region_id", tolerance: float = 0.02,
                       **size) -> DataFrame:
    """Texts of each frame, lines from the top, left to right inside a line."""
    lines = reading_order(regions, frame, id, tolerance, **size)
    members = F.sort_array(F.collect_list(F.struct("line", "x", F.col(id).alias("__id"), "text")))
    return lines.groupBy(frame).agg(F.array_join(F.transform(members, lambda m: m["text"]), "\n").alias("text"))


def crop_to_full_coords(regions: DataFrame, box: str = "bounds", crop: str = "crop", full_width: str = "full_width",
                        full_height: str = "full_height", origin: str = "top_left") -> DataFrame:
    """Normalised box inside a crop to normalised box inside the full image.

    ``origin="top_left"`` applies the plain formula to both axes; ``"bottom_left"`` corrects y for
    boxes whose origin is the lower left corner."""
    b, c = F.col(box), F.col(crop)
    fw, fh = F.col(full_width), F.col(full_height)
    y0 = c["y"] if origin == "top_left" else fh - c["y"] - c["height"]
    return regions.withColumn(box, F.struct(
        ((c["x"] + b["x"] * c["width"]) / fw).alias("x"), ((y0 + b["y"] * c["height"]) / fh).alias("y"),
        (b["width"] * c["width"] / fw).alias("width"), (b["height"] * c["height"] / fh).alias("height")))


def regions_fallback(frames: DataFrame, regions: DataFrame, limit: int = MAX_REGIONS,
                     frame: str = "frame_id") -> DataFrame:
    """How each frame is to be read: ``none`` (no region), ``regions``, or ``full`` above ``limit``."""
    counts = regions.groupBy(frame).agg(F.count(F.lit(1)).alias("regions"))
    out = frames.join(counts, frame, "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
    return out.withColumn("mode", F.when(F.col("regions") == 0, F.lit("none"))
                          .when(F.col("regions") > limit, F.lit("full")).otherwise(F.lit("regions")))
