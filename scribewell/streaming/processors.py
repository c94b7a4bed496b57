"""Keyed state of streams with types, timers and an end: recorder sessions with their windows, settings, trailing samples, and last values after a snapshot.

Values keep their types in state, whatever they are. What a stream leaves behind goes by a timer in event time once nothing has
come for ``idle_ms``; later events begin anew.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType

#: How late an event may come.
LATE = "1 minute"
#: How long a stream's state outlives its last event.
IDLE_MS = 90 * 24 * 3600 * 1000
#: Buckets of recorder streams that share a state.
BUCKETS = 4096
#: The kinds of a recorder's events, in the order in which those of one time come.
KINDS = ("setting", "start", "chunk", "stop")


def keyed_state(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Idling(StatefulProcessor):
    """State that ends. ``states`` are cleared by the one timer of a key when its last event is ``idle_ms`` old."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "last bigint, timer bigint")
        self.states = [self.times]

    def touched(self, at_ms: int, watermark: int) -> None:
        """Notes a stream's last event."""
        last, timer = self.times.get() if self.times.exists() else (None, 0)
        last = at_ms if last is None else max(last, at_ms)
        if not timer:
            timer = max(last + self.idle_ms, watermark + 1)
            self.handle.registerTimer(timer)
        self.times.update((last, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        run: list[Row] = []
        for r in in_order(rows):
            if run and r["at"] - run[-1]["at"] > 1000 * self.idle_ms:
                yield from self.folded(key, run, timerValues.getCurrentWatermarkInMs())
                run = []
            run.append(r)
        yield from self.folded(key, run, timerValues.getCurrentWatermarkInMs())

    def folded(self, key: tuple, run: list[Row], watermark: int) -> Iterator[Row]:
        """What rows in order give that have no pause of ``idle_ms`` between them. State that has ended by their time is cleared, so that what comes out doesn't depend on the batches."""
        if self.times.exists() and run[0]["at"] // 1000 > self.times.get()[0] + self.idle_ms:
            for state in self.states[1:]:
                state.clear()
        yield from self.fold(key, run)
        self.touched(run[-1]["at"] // 1000, watermark)

    def fold(self, key: tuple, run: list[Row]) -> Iterator[Row]:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        due = self.times.get()[0] + self.idle_ms if self.times.exists() else 0
        if due > expiredTimerInfo.getExpiryTimeInMs():
            # events have come since
            self.handle.registerTimer(due)
            self.times.update((due - self.idle_ms, due))
        else:
            for state in self.states:
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Kept:
    """How values of a type stand in state: as that type, or as bytes where they hold structs, which state in Python doesn't take."""

    def __init__(self, kind: str):
        self.nested = "struct<" in kind
        self.kind = "binary" if self.nested else kind

    def put(self, value: object) -> object:
        return pickle.dumps(value) if self.nested and value is not None else value

    def get(self, stored: object) -> object:
        return pickle.loads(stored) if self.nested and stored is not None else stored


def in_order(rows: Iterator[Row]) -> list[Row]:
    """A key's rows of a batch by time, kind and number."""
    return sorted(rows, key=lambda r: (r["at"], r["rank"], r["seq"]))


class Trail:
    """The last ``most`` samples of what was added, as whole chunks (seq, samples)."""

    def __init__(self, most: int, chunks: list[tuple]):
        self.most, self.chunks = most, chunks
        self.size = sum(len(c[1]) for c in chunks)

    def add(self, seq: int, samples: list[float]) -> None:
        self.chunks.append((seq, samples))
        self.size += len(samples)
        gone = 0
        while self.size - len(self.chunks[gone][1]) >= self.most:
            self.size -= len(self.chunks[gone][1])
            gone += 1
        del self.chunks[:gone]

    def samples(self) -> list[float]:
        return [x for _, samples in self.chunks for x in samples][-self.most :]


def _as_bytes(value: F.Column) -> F.Column:
    """Values of any type as bytes, so that they keep their type on the way through pandas and state; null stays null."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else pickle.dumps(x) for x in column.to_pylist()], pa.binary())

    return run(value)


def _from_bytes(stored: F.Column, kind: DataType) -> F.Column:
    shape = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else pickle.loads(x) for x in column.to_pylist()], shape)

    return run(stored)


class Recorder:
    """A recorder's session: chunks count while it records, a start when idle empties the buffer, and every chunk and every change of settings looks at the trailing window once more."""

    def __init__(self, most: int, session: int = 0, recording: bool = False, setting: bytes | None = None, last: int | None = None, chunks: list[tuple] | None = None):
        self.most, self.session, self.recording, self.setting, self.last = most, session, recording, setting, last
        self.trail = Trail(most, chunks or [])

    def take(self, kind: str, seq: int, value: bytes | None, samples: np.ndarray | None) -> tuple | None:
        """(seq, cause, session, setting, oldest, samples) if the event gives a window."""
        if kind == "start" and not self.recording:
            self.session, self.recording, self.trail = self.session + 1, True, Trail(self.most, [])
        elif kind == "stop":
            self.recording = False
        elif kind == "setting" and value is not None:
            self.setting = value
        if kind == "chunk" and self.recording and samples is not None and len(samples):
            self.trail.add(seq, samples)
        elif not (kind == "setting" and self.recording and self.trail.size):
            return None
        chunks = self.trail.chunks
        return seq, kind, self.session, self.setting, chunks[0][0], np.concatenate([c for _, c in chunks])[-self.most :]


class Recorders:
    """The recorders of the streams of a bucket, and what of them is state: a place in each array for each stream, and the chunks of all trails one after the other."""

    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms
        self.of: dict[object, Recorder] = {}

    @staticmethod
    def state(kind_of_stream: str) -> str:
        return f"streams array<{kind_of_stream}>, sessions array<bigint>, recording array<boolean>, settings array<binary>, lasts array<bigint>, counts array<int>, seqs array<bigint>, sizes array<int>, samples binary"

    def load(self, stored: tuple) -> None:
        *each, counts, seqs, sizes, data = stored
        chunks = list(zip(seqs, np.split(np.frombuffer(data, np.float32), np.cumsum(sizes, dtype=np.int64)[:-1]), strict=True)) if seqs else []
        at = 0
        for stream, session, recording, setting, last, n in zip(*each, counts, strict=True):
            self.of[stream] = Recorder(self.most, session, recording, None if setting is None else bytes(setting), last, chunks[at : at + n])
            at += n

    def stored(self) -> tuple:
        own = list(self.of.values())
        chunks = [c for r in own for c in r.trail.chunks]
        data = np.concatenate([np.zeros(0, np.float32), *[x for _, x in chunks]]).astype(np.float32).tobytes()
        return list(self.of), [r.session for r in own], [r.recording for r in own], [r.setting for r in own], [r.last for r in own], [len(r.trail.chunks) for r in own], [s for s, _ in chunks], [len(x) for _, x in chunks], data

    def drop_idle(self, watermark: int) -> None:
        self.of = {k: r for k, r in self.of.items() if r.last + self.idle_ms > watermark}

    def fold(self, stream: object, run: list[tuple], newest_only: bool) -> list[tuple]:
        """What a stream's events (at, rank, seq, value, samples, part) give, by time, kind and number."""
        run.sort(key=lambda r: r[:3])
        recorder = self.of.get(stream) or Recorder(self.most)
        found: dict[tuple, tuple] = {}
        # windows by part since the last pause
        waiting, pauses, before = Counter(), 0, recorder.last
        for at, rank, seq, value, samples, part in run:
            # state that has ended by the events' time is cleared, so that what comes out doesn't depend on the batches
            if before is not None and at // 1000 - before > self.idle_ms:
                recorder, pauses = Recorder(self.most, last=before), pauses + 1
            before = at // 1000 if before is None else max(before, at // 1000)
            window = recorder.take(KINDS[rank], seq, value, samples)
            if window is None:
                continue
            key = (pauses, part)
            waiting[key] += 1
            # the newest takes the place of the one before it, or each has its own
            found[key, None if newest_only else waiting[key]] = window
        recorder.last = before
        self.of[stream] = recorder
        return [(stream, *window, waiting[key], 1 if n is None else waiting[key] - n + 1) for (key, n), window in found.items()]


class CarriedSettings(Idling):
    """The latest setting of a stream, carried to its chunks."""

    def __init__(self, kind_of_value: str, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.kept = Kept(kind_of_value)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.setting = handle.getValueState("setting", f"value {self.kept.kind}")
        self.states.append(self.setting)

    def fold(self, key: tuple, run: list[Row]) -> Iterator[Row]:
        value = self.kept.get(self.setting.get()[0]) if self.setting.exists() else None
        out = []
        for r in run:
            if r["rank"] == 1:
                out.append(Row(stream_id=key[0], seq=r["seq"], value=value))
            elif r["value"] is not None:
                value = r["value"]
        if value is not None:
            self.setting.update((self.kept.put(value),))
        return iter(out)


class TrailingSamples(Idling):
    """A stream's last samples, after each batch that has any."""

    def __init__(self, most: int, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "seq bigint, samples array<float>")
        self.states.append(self.held)

    def fold(self, key: tuple, run: list[Row]) -> Iterator[Row]:
        trail = Trail(self.most, [tuple(c) for c in self.held.get()] if self.held.exists() else [])
        for r in run:
            trail.add(r["seq"], list(r["samples"]))
        self.held.put(trail.chunks)
        yield Row(stream_id=key[0], seq=trail.chunks[-1][0], samples=trail.samples())


class LastValues(Idling):
    """The last value of each stream, which a snapshot begins. Rows of the snapshot come out once too, unless an update has come before."""

    def __init__(self, kind_of_value: str, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.kept = Kept(kind_of_value)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", f"at bigint, seq bigint, value {self.kept.kind}")
        self.states.append(self.last)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.last.update((None, None, self.kept.put(initialState["value"])))
        # runs out as soon as there is a watermark
        self.handle.registerTimer(1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if expiredTimerInfo.getExpiryTimeInMs() != 1:
            return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        at, _, value = self.last.get()
        if at is not None:
            return iter(())
        # a row of the snapshot is as old as the watermark
        self.touched(timerValues.getCurrentWatermarkInMs(), timerValues.getCurrentWatermarkInMs())
        return iter([Row(stream_id=key[0], at=None, seq=None, value=self.kept.get(value))])

    def fold(self, key: tuple, run: list[Row]) -> Iterator[Row]:
        at, seq, _ = self.last.get() if self.last.exists() else (None, None, None)
        new = max((r for r in run if r["value"] is not None), key=lambda r: (r["at"], r["seq"]), default=None)
        if new is not None and (at is None or (new["at"], new["seq"]) > (at, seq)):
            self.last.update((new["at"], new["seq"], self.kept.put(new["value"])))
            yield Row(stream_id=key[0], at=new["at"], seq=new["seq"], value=new["value"])


def _timed(stream: DataFrame, rank: F.Column, *columns: str | F.Column) -> DataFrame:
    rows = stream.withWatermark("ts", LATE)
    return rows.select("stream_id", "ts", F.unix_micros("ts").alias("at"), rank.cast("int").alias("rank"), "seq", *columns)


def _kind(stream: DataFrame, column: str) -> str:
    return stream.schema[column].dataType.simpleString()


def recorded_windows(events: DataFrame, most: int, newest_only: bool = False, idle_ms: int = IDLE_MS, buckets: int = BUCKETS, part: F.Column | None = None) -> DataFrame:
    """(stream_id, seq, cause, session, setting, oldest, samples, n_waiting, place) of a stream of events (stream_id, ts, seq, kind, value, samples).

    ``kind`` is one of KINDS: settings have a ``value``, chunks have ``samples``. Each chunk with samples while the recorder runs, and
    each setting while it runs and has any, gives the window of the last ``most`` samples of the session, with the setting as of then.
    ``n_waiting`` counts the windows that the stream has ready in the batch, and ``place`` is a window's among them, the newest first. With ``part``, a whole
    number by event, both are of the windows of one part, so a batch may hold several; a part's events should come in one batch.
    ``newest_only`` sheds load: only the windows of the first place come out.

    Streams are dealt to ``buckets``, each with the state of its streams, as a call for each stream costs more than its events do. Buckets
    are fixed for a stream's life; a bucket's state, one part in ``buckets`` of all, has to fit into a worker.
    """
    keyed_state(events.sparkSession)
    kind = _kind(events, "stream_id")
    # null streams have a bucket of their own, as pandas makes numbers doubles where nulls are
    bucket = F.when(F.col("stream_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("stream_id"), F.lit(buckets))).cast("int")
    timed = _timed(events.withColumn("value", _as_bytes(F.col("value"))), F.array_position(F.lit(list(KINDS)), F.col("kind")) - 1, "value", "samples", (F.lit(0) if part is None else part).cast("long").alias("part"))
    rows = timed.withColumn("bucket", bucket).withColumn("stream_id", F.coalesce("stream_id", F.lit("0").cast(kind)))
    names = ["stream_id", "seq", "cause", "session", "setting", "oldest", "samples", "n_waiting", "place"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recorders, watermark = Recorders(most, idle_ms), state.getCurrentWatermarkMs()
        if state.exists:
            recorders.load(state.get)
        if not state.hasTimedOut:
            runs: dict[object, list[tuple]] = {}
            for f in frames:
                for stream, *r in zip(*[f[name].tolist() for name in ("stream_id", "at", "rank", "seq", "value", "samples", "part")], strict=True):
                    runs.setdefault(None if key[0] == -1 else stream, []).append(r)
            out = [x for stream, run in runs.items() for x in recorders.fold(stream, run, newest_only)]
            if out:
                yield pd.DataFrame(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
        recorders.drop_idle(watermark)
        if recorders.of:
            state.update(recorders.stored())
            state.setTimeoutTimestamp(max(min(r.last for r in recorders.of.values()) + idle_ms, watermark + 1))
        elif state.exists:
            state.remove()

    shape = f"stream_id {kind}, seq long, cause string, session long, setting binary, oldest long, samples array<float>, n_waiting long, place long"
    # the filter passes all rows; a function in Arrow doesn't take rows as they come from keyed state
    found = rows.groupBy("bucket").applyInPandasWithState(step, shape, Recorders.state(kind), "append", GroupStateTimeout.EventTimeTimeout).where(F.col("n_waiting") > 0)
    return found.withColumn("setting", _from_bytes(F.col("setting"), events.schema["value"].dataType))


def settings_at(stream: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(stream_id, seq, value): each chunk (kind 1) with its stream's latest setting (kind 0) at or before it."""
    keyed_state(stream.sparkSession)
    value = _kind(stream, "value")
    rows = _timed(stream, F.col("kind"), "value")
    return rows.groupBy("stream_id").transformWithState(CarriedSettings(value, idle_ms), f"stream_id {_kind(stream, 'stream_id')}, seq long, value {value}", "Append", "EventTime")


def trailing_samples(stream: DataFrame, most: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """(stream_id, seq, samples): each stream's last ``most`` samples after each batch that has any (stream_id, ts, seq, samples)."""
    keyed_state(stream.sparkSession)
    rows = _timed(stream.where(F.size("samples") > 0), F.lit(0), "samples")
    return rows.groupBy("stream_id").transformWithState(TrailingSamples(most, idle_ms), f"stream_id {_kind(stream, 'stream_id')}, seq long, samples array<float>", "Append", "EventTime")


def last_values(stream: DataFrame, snapshot: DataFrame | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """(stream_id, at, seq, value): the last value of each stream when it changes; ``snapshot`` (stream_id, value) is the state to begin with.

    Rows of the snapshot come out with a null ``at`` once there is a watermark, but for those that an update has replaced by then.
    """
    keyed_state(stream.sparkSession)
    value = _kind(stream, "value")
    rows = _timed(stream, F.lit(0), "value")
    first = None if snapshot is None else snapshot.select("stream_id", "value").groupBy("stream_id")
    shape = f"stream_id {_kind(stream, 'stream_id')}, at long, seq long, value {value}"
    return rows.groupBy("stream_id").transformWithState(LastValues(value, idle_ms), shape, "Append", "EventTime", first)
