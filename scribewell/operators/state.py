"""Keyed state as batch folds: last values, sessions, pairing, the recorder's states, messages that clear themselves.

Each is a window or an aggregate by stream, in the order of (ts, seq); aggregates combine in each task before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: seconds that an error is shown.
SHOWN_SECONDS = 8


def order() -> Column:
    return F.struct("ts", "seq")


def last_value(messages: DataFrame, value: Column, only: Column, default: Column) -> DataFrame:
    """For each stream the value of its last message for which ``only`` holds; a missing value is ``default``."""
    return messages.where(only).groupBy("stream_id").agg(F.max_by(F.coalesce(value, default), order()).alias("value"))


def snapshot_and_updates(snapshot: DataFrame, updates: DataFrame) -> DataFrame:
    """(stream_id, ts, seq, value): the latest of a snapshot's row and the updates after it."""
    both = snapshot.unionByName(updates)
    return both.groupBy("stream_id").agg(F.max_by("value", order()).alias("value"))


def sessions(messages: DataFrame, starts: Column) -> DataFrame:
    """Adds session: how many starts its stream has had, this message included; 0 before the first."""
    so_far = Window.partitionBy("stream_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("session", F.sum(F.when(starts, 1).otherwise(0)).over(so_far))


def paired(messages: DataFrame, pending: Column, ready: Column, closed: Column | None = None) -> DataFrame:
    """Each pending message with the ready message that takes it; consumed once, in either order.

    A ready message takes the last pending one since the last ready or closing message; a second one in a row takes nothing.
    """
    closed = F.lit(False) if closed is None else closed
    kind = F.when(pending, "pending").when(ready, "ready").when(closed, "closed")
    marked = messages.withColumn("kind", kind).where(F.col("kind").isNotNull())
    by = Window.partitionBy("stream_id").orderBy("ts", "seq")
    before = marked.withColumn("before_kind", F.lag("kind").over(by)).withColumn("before_seq", F.lag("seq").over(by))
    return before.where((F.col("kind") == "ready") & (F.col("before_kind") == "pending")).select("stream_id", F.col("before_seq").alias("pending_seq"), F.col("seq").alias("ready_seq"))


def recorder(messages: DataFrame, starts: Column, stops: Column) -> DataFrame:
    """The changes of a recorder: a start counts only when idle and a stop only when recording."""
    marked = messages.where(starts | stops).withColumn("state", F.when(starts, "recording").otherwise("idle"))
    by = Window.partitionBy("stream_id").orderBy("ts", "seq")
    changed = F.col("state") != F.coalesce(F.lag("state").over(by), F.lit("idle"))
    return marked.withColumn("changed", changed).where("changed").select("stream_id", "ts", "seq", "state")


def shown(messages: DataFrame, errors: Column, seconds: int = SHOWN_SECONDS) -> DataFrame:
    """For how many microseconds each error is shown.

    It ends when the next error takes its place, or when the first timer runs out after it began. Timers that
    earlier errors started aren't stopped, so that is ``seconds`` after the earliest error in the
    ``seconds`` up to this one, itself included.
    """
    span = seconds * 1_000_000
    marked = messages.where(errors).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    first = F.min("at").over(Window.partitionBy("stream_id").orderBy("at").rangeBetween(1 - span, 0))
    following = F.lead("at").over(Window.partitionBy("stream_id").orderBy("at", "seq"))
    timed = marked.withColumn("cleared", first + span).withColumn("next_at", following)
    return timed.select("stream_id", "seq", (F.least("cleared", F.coalesce("next_at", "cleared")) - F.col("at")).alias("shown_us"))


def as_of(chunks: DataFrame, settings: DataFrame, value: str) -> DataFrame:
    """Each chunk with the latest setting of its stream at or before it: both in one ordered stream, the last setting carried on."""
    left = chunks.select("stream_id", "ts", "seq", F.lit(1).alias("kind"), F.lit(None).cast(settings.schema[value].dataType).alias(value))
    right = settings.select("stream_id", "ts", "seq", F.lit(0).alias("kind"), value)
    by = Window.partitionBy("stream_id").orderBy("ts", "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return left.unionByName(right).withColumn(value, F.last(value, ignorenulls=True).over(by)).where("kind = 1").drop("kind")


def newest_by_batch(windows: DataFrame, batch: Column) -> DataFrame:
    """Load shedding: of the windows that a stream has ready in a batch only the newest is worked on."""
    return windows.withColumn("batch", batch).groupBy("stream_id", "batch").agg(F.max(order()).alias("at"), F.count("*").alias("n_waiting")).select("stream_id", "batch", F.col("at.seq").alias("seq"), "n_waiting")


#: The kinds of a recorder's events, in the order in which those of one time come.
EVENT_KINDS = ("setting", "start", "chunk", "stop")


def recorded_windows(events: DataFrame, most: int) -> DataFrame:
    """(stream_id, seq, cause, session, setting, n_samples, oldest) of events (stream_id, ts, seq, kind, value, n).

    Chunks have ``n`` samples, which count while the recorder runs; a start when it is idle begins a session. Each chunk with samples and each setting
    in a session that has any looks at the last ``most`` samples: how many there are, the chunk of the oldest one, and the setting as of then.
    """
    ranked = events.withColumn("rank", F.array_position(F.lit(list(EVENT_KINDS)), F.col("kind")) - 1)
    by = Window.partitionBy("stream_id").orderBy("ts", "rank", "seq")
    so_far, before = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, -1)
    switch = F.when(F.col("kind").isin("start", "stop"), F.col("kind"))
    marked = ranked.withColumn("state", F.last(switch, ignorenulls=True).over(so_far)).withColumn("was", F.coalesce(F.last(switch, ignorenulls=True).over(before), F.lit("stop")))
    marked = marked.withColumn("setting", F.last(F.when(F.col("kind") == "setting", F.col("value")), ignorenulls=True).over(so_far))
    begun = marked.withColumn("session", F.sum(F.when((F.col("kind") == "start") & (F.col("was") == "stop"), 1).otherwise(0)).over(so_far))
    heard = begun.where("state = 'start'").withColumn("n", F.when(F.col("kind") == "chunk", F.coalesce("n", F.lit(0))).otherwise(0).cast("long"))
    in_session = Window.partitionBy("stream_id", "session").orderBy("ts", "rank", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = heard.withColumn("sum", F.sum("n").over(in_session))
    trail = Window.partitionBy("stream_id", "session").orderBy("sum").rangeBetween(1 - most, Window.currentRow)
    oldest = F.min(F.when(F.col("n") > 0, F.struct("sum", "seq"))).over(trail)["seq"]
    looks = (F.col("sum") > 0) & ((F.col("kind") == "setting") | (F.col("n") > 0))
    out = summed.withColumn("oldest", oldest).where(looks)
    return out.select("stream_id", "seq", F.col("kind").alias("cause"), "session", "setting", F.least("sum", F.lit(most)).alias("n_samples"), "oldest")
