"""Anchored windows over a stream, and the micro-batch summariser."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from chronoscribe.operators.retention import derive_summarized
from chronoscribe.params import Params
from chronoscribe.plans.complete import Complete
from chronoscribe.plans.prompts import Templates
from chronoscribe.plans.summarize import progressive_summarize
from chronoscribe.sources.folders import Pending, dates_of
from chronoscribe.sources.tables import append_summaries, append_token_usage, read_captures, read_summaries
from chronoscribe.session import durable
from chronoscribe.streaming.ordered import Ordered, duration_ms, in_order

_MARK = T.StructType([T.StructField("anchor", T.LongType())])


class AnchorProcessor(Ordered):
    """Marks the rows of a key with the start of their window.

    A late row is emitted at once with ``late`` set and no window, so that a caller can route it to a side table. The start is
    forgotten when the watermark has passed its window: the next row opens a new one in any case."""

    def __init__(self, row: T.StructType, bucket_ms: int, window_us: int, key: str):
        super().__init__(row, bucket_ms)
        self.window_us, self.key = window_us, key

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", _MARK)

    def _frame(self, key, rows: list[tuple], starts: list[int | None]) -> pd.DataFrame:
        us, ids, *rest = zip(*rows)
        return pd.DataFrame({self.key: [key[0]] * len(rows), "id": ids, "ts": pd.to_datetime(us, unit="us"),
                             **dict(zip(self.names[2:], rest)), "windowStart": pd.to_datetime(pd.Series(starts, dtype="Int64"), unit="us"),
                             "late": [s is None for s in starts]})

    def advance(self, key, rows: list[tuple]) -> pd.DataFrame:
        anchor = self.mark.get()[0] if self.mark.exists() else None
        starts = []
        for us, *_ in rows:
            if anchor is None or us - anchor >= self.window_us:
                anchor = us
            starts.append(anchor)
        self.mark.update((anchor,))
        self.handle.registerTimer(-(-self._over(anchor) // self.bucket_ms) * self.bucket_ms)
        return self._frame(key, rows, starts)

    def late(self, key, rows: list[tuple]) -> pd.DataFrame:
        return self._frame(key, sorted(rows, key=lambda r: r[:2]), [None] * len(rows))

    def _over(self, anchor: int) -> int:
        return -(-(anchor + self.window_us) // 1000)

    def settled(self, until_ms: int) -> None:
        if self.mark.exists() and self._over(self.mark.get()[0]) <= until_ms:
            self.mark.clear()


def chunk_by_time_stream(captures: DataFrame, key: str = "device", window: float = 300.0, delay: str = "300 seconds",
                         bucket: str | None = None) -> DataFrame:
    """``(key, id, ts, appName, windowStart, late)``. ``delay`` is the time allowed for late rows; they wait in buckets of
    length ``bucket`` (a sixteenth of the delay), and a row is late once its bucket has ended before the watermark."""
    bucket_ms = duration_ms(bucket) if bucket else max(1, duration_ms(delay) // 16)
    rows = captures.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    row = T.StructType([T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), rows.schema["appName"]])
    out = T.StructType([rows.schema[key], row["id"], T.StructField("ts", T.TimestampType()), row["appName"],
                        T.StructField("windowStart", T.TimestampType()), T.StructField("late", T.BooleanType())])
    return in_order(rows, key, AnchorProcessor(row, bucket_ms, int(window * 1_000_000), key), out)


def summarize_pending(spark, captures_path: str, summaries_path: str, usage_path: str, now, complete: Complete,
                      keys: list[str] = (), params: Params = Params(), templates: Templates = Templates(),
                      model: str = "default", extra: T.StructType | None = None, tz: str = "UTC",
                      pending: str | None = None, ledger: str | None = None) -> DataFrame:
    """One round over the stored tables; returns the chunks that failed.

    Safe to repeat: chunk keys are deterministic, and whether a capture waits is read off the
    summaries table, so a crash between the two appends loses only usage counts.

    With ``pending`` (see ``append_captures``) only days that may have waiting captures are read, of both tables; a day is settled when
    none of its captures waits any more. ``ledger`` keeps replies (see ``ai_map``), so a round that is repeated calls for no
    prompt twice."""
    marks = None if pending is None else Pending(spark, pending).markers()
    days = None if marks is None else [dt.date.fromisoformat(d) for d in marks]
    # A chunk ends on the day of its captures or, at the latest, on the next one.
    ends = None if days is None else {d + dt.timedelta(days=i) for d in days for i in (0, 1)}

    def waiting() -> DataFrame:
        captures = read_captures(spark, captures_path, extra=extra, days=days)
        try:
            return derive_summarized(captures, read_summaries(spark, summaries_path, days=ends))
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return captures

    summaries, usage, failed = progressive_summarize(waiting(), now, complete, keys, params, templates, model, tz=tz, ledger=ledger)
    # The new rows are fixed before the tables they were computed from grow.
    summaries, usage = durable(summaries), durable(usage)
    append_summaries(summaries, summaries_path, "chunkKey")
    append_token_usage(usage, usage_path)
    if marks:
        left = set(dates_of(waiting().filter(~F.col("isSummarized")), "ts"))
        Pending(spark, pending).settle({d: names for d, names in marks.items() if d not in left})
    return failed


def summarize_stream(captures: DataFrame, round_: "callable", checkpoint: str, poll_seconds: float = 60.0,
                     available_now: bool = False):
    """Run ``round_(batch, epoch)`` (usually around ``summarize_pending``) whenever captures arrive."""
    writer = captures.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=f"{poll_seconds} seconds"))
    return writer.start()
