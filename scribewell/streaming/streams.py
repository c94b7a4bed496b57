"""The same operations on streams: routing, sliding windows, pairing, recorder states, errors and notices as Structured Streaming queries.

State ends with what it stands for: a pairing that is done, a recorder that is idle, notices that are gone, errors whose timers have run
out. State that has no such end is in :mod:`scribewell.streaming.processors`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scribewell.functions.web import route
from scribewell.operators.audio import HOP, SECONDS
from scribewell.operators.notices import MOST
from scribewell.operators.state import SHOWN_SECONDS
from scribewell.sources.scratch import shared_folder
from scribewell.sources.tables import messages
from scribewell.streaming.processors import LATE

#: Files of a micro-batch.
FILES = 4
#: Bytes of a row group of a replayed table.
ROW_GROUP = 4 << 20


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream, the oldest first."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern that no other table's name meets: a stream doesn't take a file's own name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/{name}[.]parquet")


def replayed(table: DataFrame, *by: str, batches: int = 8) -> DataFrame:
    """A table as a stream of about ``batches`` micro-batches in the order of ``by``: one file of the shared folder for each."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    # row groups are small, so that many tasks read a batch's file
    table.repartitionByRange(batches, *by).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # files are read by their times, and ranges are numbered in order
    parts = sorted((f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for k, part in enumerate(parts):
        files.setTimes(part, (1_700_000_000 + 60 * k) * 1000, -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with event time; time stamps without a zone are UTC."""
    return messages(event_stream(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))


#: Partitions of keyed state, each a state store and a worker: fixed for a stream's life, so chosen for it and not by the session.
PARTITIONS = 8


def drained(stream: DataFrame, mode: str = "append", partitions: int = PARTITIONS) -> DataFrame:
    """Runs a stream over all that is there now, with its keyed state in ``partitions``; what it gave, with the number of the batch, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/rows"

    def put(rows: DataFrame, batch: int) -> None:
        # a folder for each batch, so that a batch that is done again replaces itself
        rows.withColumn("batch_id", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/b={batch}")

    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions))
    try:
        # the stream takes the session's settings as they are when it starts
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    schema = stream.withColumn("batch_id", F.lit(0).cast("long")).schema
    # no batch ran where nothing was there; a failure to read is an error
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/b=*")


def routed(stream: DataFrame) -> DataFrame:
    """Stateless routing; a message that is sent again in the allowed lateness counts once."""
    once = stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["seq"])
    return once.select("seq", "stream_id", "type", route(F.col("type")).alias("route"))


def sliding_counts(stream: DataFrame) -> DataFrame:
    """Events by type in sliding windows of event time; in append mode a window comes once it is closed."""
    window = F.window("ts", f"{SECONDS} seconds", f"{HOP} seconds")
    return stream.withWatermark("ts", LATE).groupBy(window.alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("w_start"), "type", "n")


def paired(stream: DataFrame, pending: str = "start-transcription", ready: str = "recording-state", closed: str | None = None) -> DataFrame:
    """The handshake: a ready message takes its stream's last pending one, once; a closing message forgets the pending one."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for seq, kind in zip(rows["seq"], rows["type"], strict=True):
            if kind == pending:
                waiting = int(seq)
            elif kind == ready:
                if waiting is not None:
                    out.append((key[0], waiting, int(seq)))
                waiting = None
            else:
                waiting = None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((waiting,))
        yield pd.DataFrame(out, columns=["stream_id", "pending_seq", "ready_seq"])

    wanted = stream.where(F.col("type").isin(pending, ready, *([] if closed is None else [closed]))).select("stream_id", "ts", "seq", "type")
    return wanted.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, pending_seq long, ready_seq long", "pending long", "append", GroupStateTimeout.NoTimeout)


def recorder(stream: DataFrame, start: str = "start-transcription", stop: str = "stop-transcription") -> DataFrame:
    """The changes of a recorder as messages come: a start counts only when idle and a stop only when recording."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recording = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        now = (rows["type"] == start).to_numpy()
        changed = now != np.concatenate([[recording], now[:-1]])
        # no state is the same as an idle recorder's
        if now[-1]:
            state.update((True,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"].to_numpy()[changed], "state": np.where(now, "recording", "idle")[changed]})

    wanted = stream.where(F.col("type").isin(start, stop)).select("stream_id", "ts", "seq", "type")
    return wanted.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, state string", "recording boolean", "append", GroupStateTimeout.NoTimeout)


def errors_shown(errors: DataFrame, seconds: int = SHOWN_SECONDS) -> DataFrame:
    """(stream_id, seq, shown_us): for how long each error is shown, once the next one has come or a timer has run out in event time.

    Timers of earlier errors aren't stopped, so the state holds the times of the last ``seconds`` beside the error that is shown.
    """
    span = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, times = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        out = []
        ended = lambda: times[0] + span  # noqa: E731  the first timer that runs out after the last error
        if state.hasTimedOut:
            if seq is not None:
                out.append((key[0], seq, ended() - times[-1]))
            seq = None
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "seq"])
            for at, number in zip(rows["at"].tolist(), rows["seq"].tolist(), strict=True):
                if seq is not None:
                    out.append((key[0], seq, min(ended(), at) - times[-1]))
                seq, times = number, [*[t for t in times if t > at - span], at]
        # a timer outlives its error, for the next one
        due = (ended() if seq is not None else times[-1] + span) // 1000 + 1
        if seq is None and state.hasTimedOut and due < state.getCurrentWatermarkMs():
            state.remove()
        else:
            state.update((seq, times))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "shown_us"])

    rows = errors.withWatermark("ts", LATE).select("stream_id", "ts", F.unix_micros("ts").alias("at"), "seq")
    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, shown_us long", "seq long, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class Notices:
    """A stream's notices, newest first, and the removals that their dismissal has scheduled."""

    def __init__(self, most: int, after_ms: int | None, items: list[list], timers: dict[str, int]):
        self.most, self.after_ms, self.items, self.timers = most, after_ms, items, timers

    def expire(self, now: int) -> None:
        for name in [k for k, due in self.timers.items() if due <= now]:
            del self.timers[name]
            self.items = [x for x in self.items if x[0] != name]

    def take(self, action: str, name: str | None, title: str | None, now: int) -> None:
        hit = lambda x: name is None or x[0] == name
        if action == "ADD":
            self.items = [[name, title, True], *self.items][: self.most]
        elif action == "UPDATE":
            self.items = [[x[0], x[1] if title is None else title, x[2]] if x[0] == name else x for x in self.items]
        elif action == "DISMISS":
            if self.after_ms is not None:
                for k in [name] if name is not None else [x[0] for x in self.items]:
                    self.timers.setdefault(k, now + self.after_ms)  # the first one counts
            self.items = [[x[0], x[1], False] if hit(x) else x for x in self.items]
        elif action == "REMOVE":
            self.items = [x for x in self.items if not hit(x)]


def notices_kept(log: DataFrame, most: int = MOST, remove_after_ms: int | None = None) -> DataFrame:
    """(stream_id, ids, titles, opened): each stream's notices, newest first, after each batch that touches them.

    ``log`` has stream_id, ts, seq, action, id and title. With ``remove_after_ms`` a dismissed notice goes by itself so long
    after its first dismissal in event time, by the next action or by the watermark. The state holds ``most`` notices and the timers that wait.
    """
    timed = remove_after_ms is not None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, titles, opened, names, dues = state.get if state.exists else ([], [], [], [], [])
        kept = Notices(most, remove_after_ms, [list(x) for x in zip(ids, titles, opened, strict=True)], dict(zip(names, dues, strict=True)))
        if state.hasTimedOut:
            kept.expire(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(frames)).sort_values("seq")
            rows = rows.astype(object).where(rows.notna(), None)
            for now, action, name, title in zip(rows["at"], rows["action"], rows["id"], rows["title"], strict=True):
                kept.expire(now)
                kept.take(action, name, title, now)
        now = [list(x) for x in zip(*kept.items, strict=True)] or [[], [], []]
        if kept.items or kept.timers:
            state.update((*now, list(kept.timers), list(kept.timers.values())))
        elif state.exists:
            state.remove()
        if kept.timers:
            state.setTimeoutTimestamp(max(min(kept.timers.values()), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *now)], columns=["stream_id", "ids", "titles", "opened"])

    shape = "ids array<string>, titles array<string>, opened array<boolean>"
    rows = (log.withWatermark("ts", LATE) if timed else log).select("stream_id", "ts", F.unix_millis("ts").alias("at"), "seq", "action", "id", "title")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(step, f"stream_id long, {shape}", f"{shape}, names array<string>, dues array<long>", "update", timeout)
