"""Running computations over keyed sequences of any length.

A sequence is the rows of one key (device, user, group) in ``(ts, id)`` order.
As long as the longest sequence is within ``rows_per_task`` one shuffle by key
and plain window functions are the best plan. That size is measured first. When
one key is longer, its rows are cut into contiguous slices by range partitioning
on ``(key, ts, id)``; every slice is scanned on its own, and what one slice must
hand to the next travels in a carry table. A slice boundary cuts at most one
key, so the carry table has no more rows than there are slices and can always be
broadcast. Each carry table is stored by a job of its own when its column is
added, so the slices stand once in the plan of the result however many columns
are chained.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscribe.session import durable, stored

ROWS_PER_TASK = 2_000_000
_SLICE = "__slice"


def sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the longest sequence and of the table; counts are combined map-side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("longest"), F.sum("n").alias("all")).first()
    return row["longest"] or 0, row["all"] or 0


class Runs:
    """``df`` as keyed sequences. Each method adds a column and returns the runs.

    ``id`` is the table's primary key. ``needs`` names the columns, beside key, time and id, that
    the scan reads. ``measured`` has the same keys and rows as ``df`` but is cheaper to count.
    """

    def __init__(self, df: DataFrame, keys: list[str], ts: str = "ts", id: str = "id",
                 rows_per_task: int | None = None, cut: bool | None = None, slices: int | None = None,
                 needs: list[str] | None = None, measured: DataFrame | None = None):
        limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
        self.keys, self.ts, self.id = list(keys), ts, id
        self.wide, self.slices = None, 1
        one, rows = (0, 0) if cut is not None else sizes(df if measured is None else measured, self.keys)
        self.cut = cut if cut is not None else one > limit
        if self.cut:
            n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            if slices is None:
                # Range bounds come from a sample: aim at half the limit.
                n = max(n, -(-2 * rows // limit))
            self.slices = n
            if needs is not None:
                # Only what the scan looks at is sliced; the rest rejoins by id at the end.
                self.wide = df
                df = df.select(*dict.fromkeys([*self.keys, ts, id, *needs]))
            order = [F.col(c) for c in (*self.keys, ts, id)]
            df = durable(
                df.repartitionByRange(n, *order)
                .withColumn(_SLICE, F.spark_partition_id())
                .sortWithinPartitions(*order))
        self.rows = df

    # -- windows -----------------------------------------------------------

    @property
    def _local_keys(self) -> list[str]:
        return ([_SLICE] if self.cut else []) + self.keys

    @property
    def _w(self):
        return Window.partitionBy(*self._local_keys).orderBy(self.ts, self.id)

    @property
    def _upto(self):
        return self._w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _order(self) -> Column:
        return F.struct(F.col(self.ts), F.col(self.id))

    def _add(self, name: str, local: Column, partial: Column, roll, combine) -> "Runs":
        """Add ``local``; for cut keys ``combine`` it with what earlier slices carry in."""
        if not self.cut:
            self.rows = self.rows.withColumn(name, combine(local, None))
            return self
        per_slice = self.rows.groupBy(_SLICE, *self.keys).agg(partial.alias("__p"))
        across = Window.partitionBy(*self.keys)
        carry = (per_slice
                 .withColumn("__c", roll(F.col("__p"), across.orderBy(_SLICE), across))
                 .withColumn("__n", F.count(F.lit(1)).over(across))
                 .filter("__n > 1 AND __c IS NOT NULL")
                 .select(F.col(_SLICE).alias("__s"), "__c",
                         *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)]))
        carry = stored(carry)
        match = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)],
            F.col(_SLICE) == F.col("__s"))
        joined = self.rows.withColumn("__l", local).join(F.broadcast(carry), match, "left")
        drop = ["__l", "__c", "__s", *[f"__k{i}" for i in range(len(self.keys))]]
        self.rows = joined.withColumn(name, combine(F.col("__l"), F.col("__c"))).drop(*drop)
        return self

    # -- running columns ---------------------------------------------------

    def previous(self, name: str, value: Column) -> "Runs":
        """``struct(v)`` of the row before; null only on the first row of a key."""
        boxed = F.struct(value.alias("v"))
        return self._add(
            name, F.lag(boxed).over(self._w), F.max_by(boxed, self._order()),
            lambda p, w, _: F.lag(p).over(w),
            lambda local, carry: local if carry is None else F.coalesce(local, carry))

    def running_sum(self, name: str, value: Column) -> "Runs":
        """Inclusive running sum of a whole-number column."""
        before = (Window.unboundedPreceding, -1)
        return self._add(
            name, F.sum(value).over(self._upto), F.sum(value),
            lambda p, w, _: F.sum(p).over(w.rowsBetween(*before)),
            lambda local, carry: local if carry is None else local + F.coalesce(carry, F.lit(0)))

    def position(self, name: str) -> "Runs":
        """1-based position in the key."""
        return self.running_sum(name, F.lit(1).cast("long"))

    def last_where(self, name: str, cond: Column, value: Column) -> "Runs":
        """``value`` of the latest row, this one included, that meets ``cond``; else null."""
        picked = F.when(cond, value)
        before = (Window.unboundedPreceding, -1)
        return self._add(
            name, F.last(picked, ignorenulls=True).over(self._upto),
            F.max_by(picked, F.when(cond, self._order())),
            lambda p, w, _: F.last(p, ignorenulls=True).over(w.rowsBetween(*before)),
            lambda local, carry: local if carry is None else F.coalesce(local, carry))

    def total(self, name: str, value: Column) -> "Runs":
        """Sum over the whole key on every row."""
        return self._add(
            name, F.sum(value).over(Window.partitionBy(*self._local_keys)), F.sum(value),
            lambda p, _, whole: F.sum(p).over(whole),
            lambda local, carry: local if carry is None else F.coalesce(carry, local))

    # -- groups inside a key -----------------------------------------------

    def group_extent(self, group: str, low: str, high: str) -> "Runs":
        """First and last ``ts`` of each contiguous group, named by column ``group``."""
        if not self.cut:
            w = Window.partitionBy(*self.keys, group)
            self.rows = self.rows.withColumn(low, F.min(self.ts).over(w)).withColumn(high, F.max(self.ts).over(w))
            return self
        w = Window.partitionBy(*self._local_keys, group)
        mine = [F.min(self.ts).over(w).alias("__llo"), F.max(self.ts).over(w).alias("__lhi")]
        local = self.rows.select("*", *mine)
        # Only a group that lies in several slices needs more than its local
        # extent, and each slice boundary cuts at most one group.
        across = Window.partitionBy(*self.keys, group)
        wide = (self.rows.groupBy(_SLICE, *self.keys, group)
                .agg(F.min(self.ts).alias("a"), F.max(self.ts).alias("b"))
                .select("*", F.count(F.lit(1)).over(across).alias("__n"),
                        F.min("a").over(across).alias("__a"), F.max("b").over(across).alias("__b"))
                .filter("__n > 1")
                .select(F.col(_SLICE).alias("__s"), F.col(group).alias("__g"), "__a", "__b",
                        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)]))
        wide = stored(wide)
        match = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)],
            (F.col(_SLICE) == F.col("__s")) & F.col(group).eqNullSafe(F.col("__g")))
        drop = ["__llo", "__lhi", "__a", "__b", "__s", "__g", *[f"__k{i}" for i in range(len(self.keys))]]
        self.rows = (local.join(F.broadcast(wide), match, "left")
                     .withColumn(low, F.coalesce("__a", "__llo"))
                     .withColumn(high, F.coalesce("__b", "__lhi")).drop(*drop))
        return self

    def filter(self, cond: Column) -> "Runs":
        self.rows = self.rows.filter(cond)
        return self

    def with_column(self, name: str, value: Column) -> "Runs":
        self.rows = self.rows.withColumn(name, value)
        return self

    def drop(self, *names: str) -> "Runs":
        self.rows = self.rows.drop(*names)
        if self.wide is not None:
            self.wide = self.wide.drop(*names)
        return self

    def frame(self) -> DataFrame:
        rows = self.rows.drop(_SLICE) if self.cut else self.rows
        if self.wide is None:
            return rows
        added = [c for c in rows.columns if c not in self.wide.columns and c != self.id]
        return self.wide.join(rows.select(self.id, *added), self.id)
