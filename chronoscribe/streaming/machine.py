"""The frame machine: observations of one key, in order, to keyframes and deltas.

One small ``step`` serves batch and stream. What it keeps per key is the last
stored hash and the current keyframe. In a batch, whole sequences run where they
lie, sorted, inside one task; a key too long for that is cut into slices. A slice
is a function of the state that it inherits (``Slice``); the functions are composed
in a tree (see ``scans``), and then each slice runs once from its own state.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe.functions.text import normalize_text
from chronoscribe.operators.anchors import null_safe_join
from chronoscribe.operators.runs import _SLICE, Runs
from chronoscribe.operators.scans import carried
from chronoscribe.params import Params
from chronoscribe.session import stored


class State(NamedTuple):
    seen: bool = False           # there is a frame to compare with
    lastHash: str | None = None  # hash of the last stored row
    kfId: int | None = None
    kfText: str | None = None
    kfNorm: str | None = None
    kfApp: str | None = None
    kfTs: int | None = None      # microseconds


class Outcome(NamedTuple):
    decision: str                # skip, keyframe, delta
    reason: str
    stored: bool
    ocrText: str | None = None
    fullOcrText: str | None = None
    textHash: str | None = None
    keyframeId: int | None = None
    changePercentage: float | None = None


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def step(s: State, row, threshold: float, cap_us: int) -> tuple[State, Outcome]:
    """``row`` has id, us, appName, changedFraction, fullText, fullNorm, changedText, changedNorm."""
    change = row.changedFraction
    change = 1.0 if change is None or change != change else change
    if not s.seen:
        kind, reason, change = "keyframe", "first", 1.0
    elif change == 0:
        return s, Outcome("skip", "unchanged", False)
    elif change >= threshold:
        kind, reason = "keyframe", "change"
    elif row.appName != s.kfApp:
        kind, reason = "keyframe", "app"
    elif s.kfTs is None or row.us - s.kfTs >= cap_us:
        kind, reason = "keyframe", "time"
    else:
        kind, reason = "delta", "change"
    s = s._replace(seen=True)

    if kind == "keyframe":
        digest = _hash(row.fullNorm)
        if digest == s.lastHash:
            return s, Outcome(kind, reason, False)
        s = State(True, digest, int(row.id), row.fullText, row.fullNorm, row.appName, int(row.us))
        return s, Outcome(kind, reason, True, row.fullText, row.fullText, digest, None, float(change))

    digest = _hash(" ".join(t for t in (s.kfNorm, row.changedNorm) if t))
    if digest == s.lastHash:
        return s, Outcome(kind, reason, False)
    full = (s.kfText or "") + ("\n" + row.changedText if row.changedText else "")
    return (s._replace(lastHash=digest),
            Outcome(kind, reason, True, row.changedText, full, digest, s.kfId, float(change)))


OUTCOME = T.StructType([
    T.StructField("decision", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("stored", T.BooleanType()), T.StructField("ocrText", T.StringType()),
    T.StructField("fullOcrText", T.StringType()), T.StructField("textHash", T.StringType()),
    T.StructField("keyframeId", T.LongType()), T.StructField("changePercentage", T.DoubleType()),
])
_CARRIED = ["id", "ts", "appName", "windowTitle"]
_READ = ["changedFraction", "fullText", "fullNorm", "changedText", "changedNorm", "us"]


def prepare(observations: DataFrame) -> DataFrame:
    """Normalise texts in the JVM; the machine only joins and hashes them."""
    return (observations.withColumn("fullNorm", normalize_text("fullText"))
            .withColumn("changedNorm", normalize_text("changedText"))
            .withColumn("us", F.unix_micros("ts")))


def outcomes_frame(pdf: pd.DataFrame, keep: list[str], results: list[Outcome]) -> pd.DataFrame:
    out = pdf[keep].reset_index(drop=True)
    for i, name in enumerate(OUTCOME.names):
        values = [r[i] for r in results]
        out[name] = pd.array(values, dtype="Int64") if name == "keyframeId" else values
    return out


_STATE_FIELDS = [T.StructField(n, T.LongType() if n in ("kfId", "kfTs") else T.StringType()) for n in State._fields if n != "seen"]


class _Seeds:
    """Restored and inherited states: rows that sort before a key's, or a slice's, first observation."""

    @staticmethod
    def rows(restored: DataFrame, like: DataFrame, keys: list[str]) -> DataFrame:
        values = {
            "id": F.col("kfId"), "us": F.unix_micros("kfTs"), "appName": F.col("kfApp"), "fullText": F.col("kfText"),
            "fullNorm": normalize_text("kfText"), "changedText": F.col("lastHash"), "seed": F.lit(0)}
        cols = [F.col(k) if k in keys else values.get(k, F.lit(None)) for k in like.columns]
        return restored.select(*[c.cast(like.schema[n].dataType).alias(n) for c, n in zip(cols, like.columns)])

    @staticmethod
    def inherited(carry: DataFrame, like: DataFrame, keys: list[str]) -> DataFrame:
        """Packed states as rows of ``like``; 0 in ``seed`` where no frame has been seen yet, else 2."""
        own = [k for k in like.columns if k in keys or k == _SLICE]
        fields = T.StructType([*[like.schema[k] for k in own], T.StructField("seen", T.BooleanType()), *_STATE_FIELDS])

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                states = pd.DataFrame([pickle.loads(c) for c in pdf["carry"]], columns=State._fields).astype({"kfId": "Int64", "kfTs": "Int64"})
                yield pd.concat([pdf[own].reset_index(drop=True), states], axis=1)[fields.names]

        rows = carry.mapInPandas(unpack, fields)
        values = {"id": F.col("kfId"), "us": F.col("kfTs"), "appName": F.col("kfApp"), "fullText": F.col("kfText"), "fullNorm": F.col("kfNorm"),
                  "changedText": F.col("lastHash"), "seed": F.when(F.col("seen"), 2).otherwise(0)}
        cols = [F.col(k) if k in own else values.get(k, F.lit(None)) for k in like.columns]
        return rows.select(*[c.cast(like.schema[n].dataType).alias(n) for c, n in zip(cols, like.columns)])

    @staticmethod
    def state(row) -> State:
        none = lambda v: None if pd.isna(v) else v
        kf, us = none(row.id), none(row.us)
        return State(row.seed == 2, none(row.changedText), None if kf is None else int(kf), none(row.fullText), none(row.fullNorm),
                     none(row.appName), None if us is None else int(us))


def restore_state(captures: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, lastHash, kfId, kfText, kfApp, kfTs)`` from the stored captures of each key."""
    order = F.struct("ts", "id")
    is_kf = F.col("frameType") == "keyframe"
    kf = F.max_by(F.when(is_kf, F.struct("id", "ocrText", "appName", "ts")), F.when(is_kf, order))
    return captures.groupBy(*keys).agg(F.max_by("textHash", order).alias("lastHash"), kf.alias("k")).select(
        *keys, "lastHash", F.col("k.id").alias("kfId"), F.col("k.ocrText").alias("kfText"),
        F.col("k.appName").alias("kfApp"), F.col("k.ts").alias("kfTs"))


#: The way of a slice that nothing precedes.
_COLD = -1


class Summary(NamedTuple):
    """A slice as a function. ``deciding`` are the rows that tell where the first keyframe is stored, as (entry, change, app, us, digest
    of the full text, changed text); from there on only that row counts, so ``exits`` has the state that follows from each entry.
    A ``closed`` slice stores a keyframe whatever it inherits."""
    deciding: list[tuple]
    states: list[State]
    exits: dict[int, int]
    closed: bool
    rows: int


def _packed(deciding: list[tuple], found: dict[int, State], closed: bool, rows: int) -> Summary:
    states: dict[State, int] = {}
    exits = {entry: states.setdefault(state, len(states)) for entry, state in found.items()}
    return Summary(deciding, list(states), exits, closed, rows)


class Slice:
    """Builds the summary of a slice row by row: every way through it that an inherited state can take is followed, and ways that
    meet go on as one. A keyframe is at most ``cap`` old, so only rows within ``cap`` of the slice's first one can be its first
    keyframe; or the next row after them; or, where that one repeats the last text, the next row with another text."""

    def __init__(self, threshold: float, cap_us: int, cold: State = State()):
        self.threshold, self.cap = threshold, cap_us
        self.deciding: list[tuple] = []
        self.ways: dict[State, list[int]] = {cold: [_COLD]}
        self.rows, self.closed, self.overdue = 0, False, None

    def add(self, row) -> None:
        ways: dict[State, list[int]] = {}
        for state, entries in self.ways.items():
            ways.setdefault(step(state, row, self.threshold, self.cap)[0], []).extend(entries)
        if not self.rows:
            self.until = row.us + self.cap
        change = 1.0 if row.changedFraction is None or row.changedFraction != row.changedFraction else row.changedFraction
        if not self.closed and (change != 0 or not self.rows):
            digest = _hash(row.fullNorm)
            enters = True
            if row.us >= self.until and change != 0:
                enters = digest != self.overdue
                self.closed = self.overdue is not None and enters
                self.overdue = self.overdue or digest
            if enters:
                self.deciding.append((self.rows, change, row.appName, int(row.us), digest, row.changedNorm))
                fresh = State(True, digest, int(row.id), row.fullText, row.fullNorm, row.appName, int(row.us))
                ways.setdefault(fresh, []).append(self.rows)
        self.rows += 1
        self.ways = ways

    def summary(self) -> Summary:
        return _packed(self.deciding, {e: s for s, entries in self.ways.items() for e in entries}, self.closed, self.rows)


def leave(state: State | None, f: Summary, threshold: float, cap_us: int) -> State:
    """The state after a slice."""
    if state is None:
        return f.states[f.exits[_COLD]]
    for entry, change, app, us, digest, changed in f.deciding:
        if state.seen and change == 0:
            continue
        keyframe = (not state.seen or change >= threshold or app != state.kfApp or state.kfTs is None or us - state.kfTs >= cap_us)
        state = state._replace(seen=True)
        if not keyframe:
            state = state._replace(lastHash=_hash(" ".join(t for t in (state.kfNorm, changed) if t)))
        elif digest != state.lastHash:
            return f.states[f.exits[entry]]
    return state


def compose(a: Summary, b: Summary, threshold: float, cap_us: int) -> Summary:
    """``a``, then ``b``."""
    after = [leave(s, b, threshold, cap_us) for s in a.states]
    found = {entry: after[i] for entry, i in a.exits.items()}
    deciding = a.deciding
    if not a.closed:
        deciding = [*deciding, *[(entry + a.rows, *rest) for entry, *rest in b.deciding]]
        found.update({entry + a.rows: b.states[i] for entry, i in b.exits.items() if entry != _COLD})
    return _packed(deciding, found, a.closed or b.closed, a.rows + b.rows)


def _states(runs: Runs, params: Params) -> DataFrame:
    """(*keys, slice, carry): the packed state that each slice of a cut key inherits."""
    keys, threshold, cap = runs.keys, params.keyframe_threshold, int(params.max_keyframe_interval * 1_000_000)
    across = Window.partitionBy(*keys)
    cut = stored(runs.rows.groupBy(_SLICE, *keys).agg(F.lit(1).alias("__one")).withColumn("__n", F.count(F.lit(1)).over(across)).filter("__n > 1").drop("__n"))
    rows = null_safe_join(runs.rows, cut, keys, "inner", ["__one"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, place, key = None, None, None

        def done():
            return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, _SLICE: [place], "summary": [pickle.dumps(made.summary())]})

        for pdf in batches:
            row_keys = _keys_of(pdf, keys)
            for row_key, row in zip(row_keys, pdf.itertuples(index=False)):
                if made is None or row_key != key:
                    if made is not None:
                        yield done()
                    made, place, key = Slice(threshold, cap), int(pdf[_SLICE].iloc[0]), row_key
                if row.seed != 1:
                    made = Slice(threshold, cap, _Seeds.state(row))
                else:
                    made.add(row)
        if made is not None:
            yield done()

    schema = T.StructType([*[runs.rows.schema[k] for k in keys], T.StructField(_SLICE, T.IntegerType()), T.StructField("summary", T.BinaryType())])

    def combine(a: bytes, b: bytes) -> bytes:
        return pickle.dumps(compose(pickle.loads(a), pickle.loads(b), threshold, cap))

    def apply(state: bytes | None, f: bytes) -> bytes:
        return pickle.dumps(leave(None if state is None else pickle.loads(state), pickle.loads(f), threshold, cap))

    return carried(rows.mapInPandas(run, schema), keys, _SLICE, runs.slices, combine, apply)


def _keys_of(pdf: pd.DataFrame, names: list[str]) -> list[tuple]:
    return list(zip(*[pdf[n].astype(object).where(pdf[n].notna(), None).tolist() for n in names])) if names else [()] * len(pdf)


def _runner(group: list[str], keep: list[str], params: Params):
    """mapInPandas function over sorted rows: the outcome of each."""
    threshold, cap = params.keyframe_threshold, int(params.max_keyframe_interval * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        for pdf in batches:
            results, kept = [], []
            for row_key, row in zip(_keys_of(pdf, group), pdf.itertuples(index=False)):
                if row_key != key:
                    key, state = row_key, State()
                kept.append(row.seed == 1)
                if row.seed != 1:
                    state = _Seeds.state(row)
                    continue
                state, outcome = step(state, row, threshold, cap)
                results.append(outcome)
            yield outcomes_frame(pdf[kept], keep, results)

    return run


def classify_frames(observations: DataFrame, keys: list[str] = ("device",), params: Params = Params(),
                    restored: DataFrame | None = None, **size) -> DataFrame:
    """Every observation with its decision, reason, whether it is stored, and what is stored."""
    keys = list(keys)
    rows = prepare(observations).select(*dict.fromkeys([*keys, *_CARRIED, *_READ])).withColumn("seed", F.lit(1))
    if restored is not None:
        rows = rows.unionByName(_Seeds.rows(restored, rows, keys).withColumn("seed", F.lit(0)))
    # A seed has no time, so it sorts first.
    runs = Runs(rows, keys, **size)
    keep = list(dict.fromkeys([*keys, *_CARRIED]))
    schema = T.StructType([*[rows.schema[c] for c in keep], *OUTCOME.fields])
    if not runs.cut:
        ordered = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "ts", "id")
        return ordered.mapInPandas(_runner(keys, keep, params), schema)
    # Inherited states are rows too: they sort before the first observation of their slice.
    inherited = _Seeds.inherited(_states(runs, params), runs.rows, keys)
    ordered = (runs.rows.unionByName(inherited).repartition(runs.slices, _SLICE)
               .sortWithinPartitions(_SLICE, *keys, "ts", "id"))
    return ordered.mapInPandas(_runner([_SLICE, *keys], keep, params), schema)


def materialize_frames(observations: DataFrame, keys: list[str] = ("device",), params: Params = Params(),
                       restored: DataFrame | None = None, **size) -> DataFrame:
    """Captures to store: duplicates of the last stored text and skipped frames are gone."""
    out = classify_frames(observations, keys, params, restored, **size).filter("stored")
    return out.select(*dict.fromkeys([*keys, *_CARRIED]), "ocrText", "fullOcrText", "textHash",
                      F.lit(False).alias("isSummarized"), F.col("decision").alias("frameType"), "keyframeId",
                      "changePercentage")
