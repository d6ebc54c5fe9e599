"""Joins and ordered unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoscribe.operators.scan import newest
from chronoscribe.operators.sequence import look_up
from chronoscribe.session import stored

# Rows of a part of a crowded bucket; pairs that a task compares, about; crowded buckets that are broadcast; tasks of the join.
PART, PAIRS_PER_TASK, BROADCAST_CELLS, MOST_TASKS = 2_000, 50_000_000, 200_000, 20_000


def _laid(df: DataFrame, start: str, end: str, name: str, base_seconds: int) -> DataFrame:
    """Ends in order (``__lo``, ``__hi``, microseconds) and the level: intervals of a level are at most as long as its
    buckets, ``base_seconds * 2**level``."""
    a, b = F.unix_micros(start), F.unix_micros(end)
    base = base_seconds * 1_000_000
    out = df.withColumn(f"__{name}lo", F.least(a, b)).withColumn(f"__{name}hi", F.greatest(a, b))
    parts = (F.col(f"__{name}hi") - F.col(f"__{name}lo")) / F.lit(base)
    return out.withColumn(f"__{name}level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(parts, F.lit(1.0))))).cast("int"))


def summaries_in_ranges(summaries: DataFrame, ranges: DataFrame, base_seconds: int = 60) -> DataFrame:
    """Summaries against many closed ranges ``(range_id, start, end)`` by ``endTs >= start AND startTs <= end``.

    Intervals are sorted into levels by length. A pair meets at the higher of its two levels, where either
    lies in at most two buckets (three at a rounding edge), so a range of any length is a few rows for each level
    that the other side has. The levels of both sides, some dozens of numbers, are read first. A pair that
    shares two buckets is kept in the first of them. Buckets with many pairs, as long ranges have, are dealt as a grid:
    a side is split into parts of some ``PART`` rows, and each part of one side meets each part of the other."""
    left = _laid(summaries, "startTs", "endTs", "l", base_seconds)
    right = _laid(ranges, "start", "end", "r", base_seconds)

    def levels(df: DataFrame, name: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"__{name}level").filter(F.col(f"__{name}level").isNotNull()).distinct().collect())

    every = {"l": levels(left, "l"), "r": levels(right, "r")}

    def dealt(df: DataFrame, name: str, other: str) -> DataFrame:
        own = F.col(f"__{name}level")
        above = F.filter(F.lit(every[other]).cast("array<int>"), lambda x: x > own)
        at = df.withColumn("__m", F.explode(F.concat(F.array(own), above)))
        width = F.lit(base_seconds * 1_000_000) * F.pow(F.lit(2.0), F.col("__m")).cast("long")
        first = F.col(f"__{name}lo") - F.pmod(F.col(f"__{name}lo"), width)
        at = at.withColumn("__w", width).withColumn(f"__{name}first", first)
        return at.withColumn("__b", F.explode(F.sequence(f"__{name}first", F.col(f"__{name}hi") - F.pmod(F.col(f"__{name}hi"), F.col("__w")), "__w"))).drop("__w")

    left, right, cell = dealt(left, "l", "r"), dealt(right, "r", "l"), ["__m", "__b"]
    sides = [df.groupBy(*cell).agg(F.count(F.lit(1)).alias(f"__n{n}")) for df, n in ((left, "l"), (right, "r"))]
    crowded = stored(sides[0].join(sides[1], cell).filter(F.col("__nl") * F.col("__nr") > PART * PART))
    cells, pairs = crowded.agg(F.count(F.lit(1)), F.sum(F.col("__nl").cast("double") * F.col("__nr"))).first()
    if cells:
        few = F.broadcast(crowded) if cells <= BROADCAST_CELLS else crowded
        n = min(MOST_TASKS, max(int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS_PER_TASK)))

        def parted(df: DataFrame, name: str, other: str, own: list[str]) -> DataFrame:
            count = lambda x: F.coalesce(F.ceil(F.col(f"__n{x}") / F.lit(PART)), F.lit(1)).cast("int")
            df = df.join(few, cell, "left").withColumn(f"__{name}part", F.pmod(F.xxhash64(*own), count(name)).cast("int"))
            df = df.withColumn(f"__{other}part", F.explode(F.sequence(F.lit(0), count(other) - 1))).drop("__nl", "__nr")
            cell_part = [*cell, "__lpart", "__rpart"]
            return df.repartition(n, *cell_part)

        left = parted(left, "l", "r", [c for c in ("id", "startTs", "endTs") if c in summaries.columns])
        right = parted(right, "r", "l", [c for c in ("range_id", "start", "end") if c in ranges.columns])
        cell = [*cell, "__lpart", "__rpart"]
    met = left.join(right, cell)
    overlap = (F.col("endTs") >= F.col("start")) & (F.col("startTs") <= F.col("end"))
    own_level = F.col("__m") == F.greatest("__llevel", "__rlevel")
    once = F.col("__b") == F.greatest("__lfirst", "__rfirst")
    return met.filter(overlap & own_level & once).drop(
        "__m", "__b", *[f"__{n}{c}" for n in "lr" for c in ("lo", "hi", "level", "first", "part")])


def resolve_captures(captures: DataFrame, summaries: DataFrame, relevant: DataFrame,
                     keys: list[str] = (), limit: int | None = None) -> DataFrame:
    """Captures behind the relevant summaries ``(*keys, id)``, each once per key, newest first.

    All summaries are consulted, unless the caller asks for the newest ``limit`` only."""
    keys = list(keys)
    consulted = summaries.select("id", "startTs", "captureIds")
    if limit is not None:
        consulted = newest(consulted, limit, ts="startTs")
    ids = (relevant.select(*keys, "id").join(consulted, "id")
           .select(*keys, F.explode("captureIds").alias("__id")).distinct())
    if not keys:
        return newest(captures.join(ids, F.col("id") == F.col("__id"), "left_semi"), None)
    return captures.join(ids, F.col("id") == F.col("__id")).drop("__id")


def with_parent(captures: DataFrame, columns: list[str] = ("ts", "appName", "ocrText")) -> DataFrame:
    """Deltas with ``parent_*`` columns of their keyframe; null where the parent is gone.

    Only the named parent columns travel. Deltas without a parent id are kept out of the match by
    their own id; a parent with very many deltas is split by adaptive skew handling."""
    deltas = captures.filter(F.col("frameType") == "delta")
    parents = captures.select(F.col("id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in columns],
                              F.lit(True).alias("__asks"))
    return look_up(deltas, F.col("keyframeId").isNotNull(), "keyframeId", parents, "parent_id")


def ordered_union_distinct(parts: list[DataFrame], id: str = "id", position: str | None = None,
                           keys: list[str] = ()) -> DataFrame:
    """First occurrence of each id over lists in priority order.

    The result has ``priority`` (list number) and keeps ``position`` (order inside a list)."""
    cols = [c for c in parts[0].columns]
    tagged = [p.select(*cols).withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    order = [F.col("priority")] + ([F.col(position)] if position else [])
    first = Window.partitionBy(*keys, id).orderBy(*order)
    return every.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")


def merge_candidates(a: DataFrame, b: DataFrame, n: int = 50, keys: list[str] = ()) -> DataFrame:
    """Union of two capture lists, distinct by id, the newest ``n`` (per key).

    The final order is by time, so which list an id came from plays no part."""
    keys = list(keys)
    every = a.unionByName(b).dropDuplicates([*keys, "id"])
    if not keys:
        return newest(every, n)
    per_key = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("id").desc())
    return every.withColumn("position", F.row_number().over(per_key)).filter(F.col("position") <= n)
