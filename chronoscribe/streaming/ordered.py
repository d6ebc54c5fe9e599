"""Keyed state that gives a processor its rows in time order, although they arrive in any order.

Rows wait in time buckets. A bucket is a list of chunks, one for each micro-batch that brought rows for it, so a batch
writes the rows that it brings and reads none that wait. Each bucket has one timer, at its end. When the watermark passes it, the bucket's
chunks are read, sorted, handed on and removed; other buckets are not touched. A row whose bucket the watermark has passed
before the row came is late and is handed on as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with several variables of one key needs this provider.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BUCKET = T.StructType([T.StructField("bucket", T.LongType())])
_CHUNK = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType())])
_COUNT = T.StructType([T.StructField("chunks", T.LongType())])


def keyed_state(spark: SparkSession) -> None:
    """Let streams that this session starts keep their state in a store that holds several variables of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def duration_ms(text: str) -> int:
    """Whole milliseconds of a duration such as ``300 seconds``."""
    return int(pd.Timedelta(text) / pd.Timedelta("1ms"))


def records(frame: pd.DataFrame, names: list[str]) -> list[tuple]:
    """Rows as tuples of plain values; a missing value is None."""
    columns = [frame[n].astype(object).where(frame[n].notna(), None).tolist() for n in names]
    return list(zip(*columns))


class Ordered(StatefulProcessor):
    """Subclasses say what happens to rows: ``open`` makes their own state, ``advance`` gets rows in the order of (us, id),
    ``late`` those that came too late. The first two fields of ``row`` are ``us`` (microseconds) and ``id``."""

    def __init__(self, row: T.StructType, bucket_ms: int):
        self.row, self.names, self.bucket_ms = row, row.fieldNames(), max(1, int(bucket_ms))

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def advance(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def late(self, key, rows: list[tuple]) -> pd.DataFrame | None:
        return None

    def settled(self, until_ms: int) -> None:
        """All rows before ``until_ms`` have been handed on. Own timers are set to ends of buckets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = T.StructType([T.StructField("rows", T.ArrayType(self.row))])
        self.counts = handle.getMapState("counts", _BUCKET, _COUNT)
        self.chunks = handle.getMapState("chunks", _CHUNK, rows)
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // self.bucket_ms
        fresh: dict[int, list[tuple]] = {}
        missed = []
        for frame in rows:
            for r in records(frame, self.names):
                bucket = r[0] // (1000 * self.bucket_ms)
                if bucket < passed:
                    missed.append(r)
                else:
                    fresh.setdefault(bucket, []).append(r)
        for bucket, held in fresh.items():
            n = self.counts.getValue((bucket,))[0] if self.counts.containsKey((bucket,)) else 0
            if not n:
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)
            self.chunks.updateValue((bucket, n), (held,))
            self.counts.updateValue((bucket,), (n + 1,))
        out = self.late(key, missed) if missed else None
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A key's timers come in the order of their times.
        until = expiredTimerInfo.getExpiryTimeInMs()
        place = (until // self.bucket_ms - 1,)
        if self.counts.containsKey(place):
            rows = []
            for chunk in range(self.counts.getValue(place)[0]):
                rows += [tuple(r) for r in self.chunks.getValue((*place, chunk))[0]]
                self.chunks.removeKey((*place, chunk))
            self.counts.removeKey(place)
            yield self.advance(key, sorted(rows, key=lambda r: r[:2]))
        self.settled(until)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, processor: Ordered, out: T.StructType) -> DataFrame:
    """``rows`` has ``key`` and the processor's fields, and a watermark further up. The column with the watermark must not be among
    them: Spark drops late rows where it is seen."""
    keyed_state(rows.sparkSession)
    return rows.select(key, *processor.names).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
