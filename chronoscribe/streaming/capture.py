"""Capture streams: source, frame machine, duplicate removal, tail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoscribe import schema as S
from chronoscribe.functions.text import dedup_hash
from chronoscribe.params import Params
from chronoscribe.streaming.machine import OUTCOME, State, outcomes_frame, prepare, step
from chronoscribe.streaming.ordered import Ordered, duration_ms, in_order, keyed_state

_STATE = T.StructType([
    T.StructField("seen", T.BooleanType()), T.StructField("lastHash", T.StringType()),
    T.StructField("kfId", T.LongType()), T.StructField("kfText", T.StringType()),
    T.StructField("kfNorm", T.StringType()), T.StructField("kfApp", T.StringType()),
    T.StructField("kfTs", T.LongType()),
])
_KEEP = ["device", "id", "ts", "appName", "windowTitle"]


def stream_captures(spark: SparkSession, path: str, schema: T.StructType = S.OBSERVATIONS, fmt: str = "parquet",
                    max_files: int | None = None) -> DataFrame:
    """Files of a folder as a stream with a fixed schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def kafka_captures(spark: SparkSession, servers: str, topic: str, schema: T.StructType = S.OBSERVATIONS) -> DataFrame:
    """JSON messages of a topic as a stream (needs the Kafka package on the cluster)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


class FrameProcessor(StatefulProcessor):
    """The frame machine with its state in the state store; one key is one device."""

    def __init__(self, params: Params):
        self.threshold = params.keyframe_threshold
        self.cap = int(params.max_keyframe_interval * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("frame", _STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        none = lambda v: None if pd.isna(v) else v
        self.state.update((False, none(r["lastHash"]), none(r["kfId"]), none(r["kfText"]), none(r["kfNorm"]),
                           none(r["kfApp"]), none(r["kfUs"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = State(*self.state.get()) if self.state.exists() else State()
        # Only the rows of this key in this micro-batch.
        pdf = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        results = []
        for row in pdf.itertuples(index=False):
            s, outcome = step(s, row, self.threshold, self.cap)
            results.append(outcome)
        self.state.update(tuple(s))
        yield outcomes_frame(pdf, _KEEP, results)

    def close(self) -> None:
        pass


def classify_frames_stream(observations: DataFrame, params: Params = Params(),
                           restored: DataFrame | None = None) -> DataFrame:
    """Streaming form of ``classify_frames`` keyed by ``device``. ``restored`` (see
    ``restore_state``) starts a new query from stored captures."""
    rows = prepare(observations)
    keyed_state(rows.sparkSession)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in _KEEP], *OUTCOME.fields])
    schema = T.StructType(sorted(schema.fields, key=lambda f: ([*_KEEP, *OUTCOME.names].index(f.name))))
    initial = None
    if restored is not None:
        from chronoscribe.functions.text import normalize_text
        initial = restored.select(
            "device", "lastHash", "kfId", "kfText", normalize_text("kfText").alias("kfNorm"), "kfApp",
            F.unix_micros("kfTs").alias("kfUs")).groupBy("device")
    return rows.groupBy("device").transformWithStateInPandas(
        statefulProcessor=FrameProcessor(params), outputStructType=schema, outputMode="Append", timeMode="None",
        initialState=initial)


_HASH = T.StructType([T.StructField("hash", T.StringType())])


class _LastHash(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _HASH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        previous = [before, *pdf["textHash"].tolist()[:-1]]
        self.last.update((pdf["textHash"].iloc[-1],))
        yield pdf[[h != p for h, p in zip(pdf["textHash"], previous)]]

    def close(self) -> None:
        pass


class _LastHashInOrder(Ordered):
    """Rows of a key that differ from the row before them in time; a late row is dropped."""

    def __init__(self, row: T.StructType, bucket_ms: int, out: list[str], key: str):
        super().__init__(row, bucket_ms)
        self.out, self.key, self.at = out, key, row.fieldNames().index("textHash")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _HASH)

    def advance(self, key, rows: list[tuple]) -> pd.DataFrame:
        before = self.last.get()[0] if self.last.exists() else None
        kept = []
        for r in rows:
            if r[self.at] != before:
                kept.append(r)
            before = r[self.at]
        self.last.update((before,))
        frame = pd.DataFrame(kept, columns=self.names).astype({"us": "int64"})
        return frame.assign(**{self.key: key[0], "ts": pd.to_datetime(frame["us"], unit="us")})[self.out]


def dedup_consecutive_stream(captures: DataFrame, key: str = "device", text: str = "fullOcrText", delay: str | None = None,
                             bucket: str | None = None) -> DataFrame:
    """Drop rows whose hash equals that of the row before them in the key.

    Without ``delay`` rows are taken in the order in which they arrive, sorted within a batch. With it they wait until the
    watermark has passed them (see ``ordered``), so that the result does not depend on how they arrive; what comes later is dropped."""
    rows = captures if "textHash" in captures.columns else captures.withColumn("textHash", dedup_hash(text))
    keyed_state(rows.sparkSession)
    if delay is None:
        return rows.groupBy(key).transformWithStateInPandas(
            statefulProcessor=_LastHash(), outputStructType=rows.schema, outputMode="Append", timeMode="None")
    bucket_ms = duration_ms(bucket) if bucket else max(1, duration_ms(delay) // 16)
    row = T.StructType([T.StructField("us", T.LongType()), rows.schema["id"], *[f for f in rows.schema.fields if f.name not in (key, "id", "ts")]])
    timed = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return in_order(timed, key, _LastHashInOrder(row, bucket_ms, rows.columns, key), rows.schema)


def dedup_within(captures: DataFrame, delay: str = "300 seconds", keys: list[str] = ("device",),
                 text: str = "fullOcrText") -> DataFrame:
    """Drop texts that a key has shown before within ``delay``."""
    rows = captures if "textHash" in captures.columns else captures.withColumn("textHash", dedup_hash(text))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*keys, "textHash"])


def tail_stream(captures: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                available_now: bool = False):
    """New rows, batch by batch, to ``sink``; the checkpoint remembers what was shown."""
    writer = captures.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()


