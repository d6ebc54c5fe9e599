"""Sequence operators: chunks, keyframe groups, even sampling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscribe.functions.clock import elapsed_seconds, instant
from chronoscribe.operators.anchors import mark_anchors
from chronoscribe.operators.runs import Runs

KEYFRAME, DELTA = "keyframe", "delta"


def is_keyframe() -> Column:
    return F.col("frameType") == KEYFRAME


# -- chunks ----------------------------------------------------------------


def _windows(runs: Runs, seconds: float) -> Runs:
    runs.with_column("__us", F.unix_micros(runs.ts))
    mark_anchors(runs, "__us", int(round(seconds * 1_000_000)), "__start")
    return runs.with_column("windowStart", F.timestamp_micros("__start")).drop("__us", "__start")


def chunk_by_time(df: DataFrame, keys: list[str] = (), window: float = 300.0, **size) -> DataFrame:
    """Add ``windowStart``: anchored windows of ``window`` seconds per key."""
    return _windows(Runs(df, list(keys), needs=[], **size), window).frame()


def _mark_starts(runs: Runs, starts: Column) -> Runs:
    """``chunkId``/``chunkStart`` of the latest row where ``starts`` holds."""
    here = F.struct(F.col(runs.ts).alias("ts"), F.col(runs.id).alias("id"))
    runs.with_column("__new", starts)
    runs.last_where("__chunk", F.col("__new"), here)
    return runs


def chunk_by_app_switch(df: DataFrame, keys: list[str] = (), app: str = "appName", **size) -> DataFrame:
    """Add ``chunkId`` (id of the chunk's first row): a chunk ends where the app changes."""
    runs = Runs(df, list(keys), needs=[app], **size).previous("__prev", F.col(app))
    _mark_starts(runs, F.col("__prev").isNull() | ~F.col("__prev.v").eqNullSafe(F.col(app)))
    return (runs.with_column("chunkId", F.col("__chunk.id"))
            .drop("__prev", "__new", "__chunk").frame())


def merge_short_chunks(chunks: DataFrame, keys: list[str] = (), minimum: float = 15.0, id: str = "chunkId",
                       start: str = "startTs", end: str = "endTs", **size) -> DataFrame:
    """Over a table of chunks add ``mergedId``: a chunk shorter than ``minimum`` seconds joins
    the one before it; the first chunk of a key stands on its own."""
    runs = Runs(chunks, list(keys), ts=start, id=id, needs=[end], **size).previous("__prev", F.col(id))
    own = F.col("__prev").isNull() | (elapsed_seconds(start, end) >= F.lit(float(minimum)))
    runs.last_where("mergedId", own if minimum > 0 else F.lit(True), F.col(id))
    return runs.drop("__prev").frame()


def hybrid_runs(runs: Runs, window: float, minimum: float, app: str = "appName") -> Runs:
    """``chunk_hybrid`` on measured sequences."""
    _windows(runs, window)
    runs.previous("__prev", F.struct(F.col("windowStart"), F.col(app).alias("app")))
    opens = F.col("__prev").isNull() | (F.col("__prev.v.windowStart") != F.col("windowStart"))
    runs.with_column("__opens", opens)
    _mark_starts(runs, opens | ~F.col("__prev.v.app").eqNullSafe(F.col(app)))
    if minimum > 0:
        runs.group_extent("__chunk", "__lo", "__hi")
        long_enough = elapsed_seconds("__lo", "__hi") >= F.lit(float(minimum))
        runs.with_column("__own", F.col("__new") & (F.col("__opens") | long_enough))
        here = F.struct(F.col(runs.ts).alias("ts"), F.col(runs.id).alias("id"))
        runs.last_where("__merged", F.col("__own"), here)
    else:
        runs.with_column("__merged", F.col("__chunk"))
    return (runs.with_column("chunkId", F.col("__merged.id"))
            .drop("__prev", "__opens", "__new", "__chunk", "__lo", "__hi", "__own", "__merged"))


def chunk_hybrid(df: DataFrame, keys: list[str] = (), window: float = 300.0, minimum: float = 15.0,
                 app: str = "appName", **size) -> DataFrame:
    """Add ``windowStart`` and ``chunkId``: anchored windows, cut at app switches, then chunks
    shorter than ``minimum`` seconds joined to the chunk before them in the same window."""
    return hybrid_runs(Runs(df, list(keys), needs=[app], **size), window, minimum, app).frame()


def chunk_feature_columns(ts: str = "ts", id: str = "id", members_too: bool = True) -> list[Column]:
    order = F.struct(F.col(ts), F.col(id))
    members = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(id).alias("i"))))
    return [
        F.min(ts).alias("startTs"),
        F.max(ts).alias("endTs"),
        F.count(F.lit(1)).alias("captureCount"),
        F.mode(F.col("appName"), True).alias("primaryApp"),
        F.sort_array(F.collect_set("appName")).alias("appNames"),
        F.max_by(F.struct(F.col("windowTitle").alias("v")), order)["v"].alias("primaryWindowTitle"),
        *([F.transform(members, lambda m: m["i"]).alias("captureIds")] if members_too else []),
    ]


def chunk_features(chunked: DataFrame, keys: list[str] = (), chunk: str = "chunkId",
                   ts: str = "ts", id: str = "id", members: bool = True) -> DataFrame:
    """One row per chunk: time span, most frequent app (ties: alphabetical), sorted apps, title of
    the last row, member ids in order.

    The ids of a chunk are one array. Hybrid chunks and windows bound it; for chunks that nothing bounds
    (``chunk_by_app_switch``) ``members=False`` leaves it out."""
    return chunked.groupBy(*keys, chunk).agg(*chunk_feature_columns(ts, id, members))


# -- keyframe groups ---------------------------------------------------------


def _walk_groups(runs: Runs) -> Runs:
    """``__head``: the row heads a group; ``__group``: (ts, id) of the head."""
    here = F.struct(F.col(runs.ts).alias("ts"), F.col(runs.id).alias("id"))
    runs.last_where("__kf", is_keyframe(), here)
    runs.with_column("__head", is_keyframe() | F.col("__kf").isNull())
    return runs.with_column("__group", F.coalesce("__kf", here)).drop("__kf")


def group_captures(df: DataFrame, keys: list[str] = (), **size) -> DataFrame:
    """Add ``groupId`` (id of the head) and ``isHead``: a keyframe opens a group, later deltas join
    it by position, deltas before any keyframe stand alone."""
    runs = _walk_groups(Runs(df, list(keys), needs=["frameType"], **size))
    return (runs.with_column("groupId", F.col("__group.id")).with_column("isHead", F.col("__head"))
            .drop("__head", "__group").frame())


def look_up(rows: DataFrame, asks: Column, key: str, found: DataFrame, found_key: str, own: str = "id") -> DataFrame:
    """Left join of the rows where ``asks`` holds with ``found`` (unique ``found_key`` and a true
    ``__asks``). The other rows join on their own id, flagged so that they meet nothing: as nulls
    they would all fall into one partition."""
    flagged = rows.withColumn("__ask", F.coalesce(asks, F.lit(False))).withColumn(
        "__key", F.when(F.col("__ask"), F.col(key)).otherwise(F.col(own)))
    hit = (F.col("__ask") == F.col("__asks")) & (F.col("__key") == F.col(found_key))
    return flagged.join(found, hit, "left").drop("__ask", "__key", "__asks")


def capture_groups(table: DataFrame, start: dt.datetime | Column | str, end: dt.datetime | Column | str,
                   keys: list[str] = (), limit: int | None = None, **size) -> DataFrame:
    """Groups of the rows in the closed range. ``groupId`` as in ``group_captures``, except that a
    leading delta whose parent row exists anywhere in ``table`` continues that parent's group, and
    so do the deltas after it. ``parentOutside`` marks groups whose head is such a parent."""
    keys = list(keys)
    rows = table.filter(F.col("ts").between(instant(start), instant(end)))
    if limit is not None:
        rows = rows.orderBy("ts", "id").limit(limit)
    # Parent lookup. The ids that are asked for are made distinct and looked up in the id column of
    # the table first, so one parent with very many deltas is a single row there.
    in_range = rows
    asked = rows.filter(~is_keyframe() & F.col("keyframeId").isNotNull()).select(F.col("keyframeId").alias("__a")).distinct()
    living = (table.select(F.col("id").alias("__pid")).join(asked, F.col("__pid") == F.col("__a"), "left_semi")
              .withColumn("__asks", F.lit(True)))
    rows = look_up(rows, ~is_keyframe() & F.col("keyframeId").isNotNull(), "keyframeId", living, "__pid")
    runs = Runs(rows, keys, needs=["frameType", "__pid"], measured=in_range, **size)
    head = F.struct(F.coalesce(F.when(is_keyframe(), F.col("id")), F.col("__pid")).alias("id"),
                    F.lit(False).alias("own"), (~is_keyframe()).alias("outside"))
    # A keyframe, or a delta with a living parent, can set the current head. A delta does so only
    # while no head is known, so it is the first such row that counts, or a keyframe after it.
    runs.with_column("__sets", is_keyframe() | F.col("__pid").isNotNull())
    runs.running_sum("__nsets", F.col("__sets").cast("long"))
    runs.last_where("__cur", is_keyframe() | (F.col("__sets") & (F.col("__nsets") == 1)), head)
    return (runs.with_column("groupId", F.coalesce(F.col("__cur.id"), F.col("id")))
            .with_column("parentOutside", F.coalesce(F.col("__cur.outside"), F.lit(False)))
            .drop("__pid", "__sets", "__nsets", "__cur").frame())


def group_members(grouped: DataFrame, keys: list[str] = (), **size) -> DataFrame:
    """Add ``position`` (1 = head) and ``groupSize`` inside each ``groupId``."""
    return (Runs(grouped, [*keys, "groupId"], needs=[], **size).position("position")
            .total("groupSize", F.lit(1).cast("long")).frame())


# -- even sampling -----------------------------------------------------------


def is_evenly_spaced(index: Column, count: Column, k: int) -> Column:
    """0-based ``index`` belongs to ``k`` evenly spaced ones out of ``count``. The step is taken
    first, in double precision, and each multiple is cut to a whole number."""
    if k <= 1:
        return (count <= k) | ((index == 0) & F.lit(k == 1))
    step = (count - 1).cast("double") / F.lit(float(k - 1))
    near = F.floor(index.cast("double") / F.nullif(step, F.lit(0.0)))
    # Rounding aside, only the multiples next to the index can be cut to it.
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = near + d
        hit = hit | (i.between(0, k - 1) & ((i.cast("double") * step).cast("long") == index.cast("long")))
    return (count <= k) | F.coalesce(hit, F.lit(False))


def evenly_spaced(df: DataFrame, k: int, keys: list[str] = (), **size) -> DataFrame:
    """Keep ``k`` evenly spaced rows per key (all of them if there are no more than ``k``)."""
    runs = Runs(df, list(keys), needs=[], **size).position("__pos").total("__n", F.lit(1).cast("long"))
    return (runs.filter(is_evenly_spaced(F.col("__pos") - 1, F.col("__n"), k))
            .drop("__pos", "__n").frame())
