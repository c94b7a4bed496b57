"""Ordered folds of streams of any length: no task gets a long stream whole.

Rows are dealt by ranges of (stream, order), so a stream with a third of all rows lies in as many tasks as its rows fill. A fold goes
over each segment (a stream's rows in one range), and what the segments before a row add up to or leave is carried to it. Only streams that
cross a border have something to carry: fewer rows than there are ranges, and so these can go to all tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribewell.sources.scratch import shared_folder

IN_SEGMENT = ("stream_id", "segment")


def segmented(rows: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """``rows`` as a table of the shared folder with segment, the number of the range that a row lies in; ranges have about as many rows each.

    Rows of a stream that are equal in ``order`` are in one segment. Null streams are a stream.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "stream_id", *order)
    # written, so that a row has the same segment for every reader
    dealt.withColumn("segment", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def _carried(rows: DataFrame, summary: Column, fold: Column, after: bool = False) -> DataFrame:
    """``rows`` with carried: the ``fold`` of the ``summary`` of the stream's segments before (or ``after``) a row's own; null where there is none."""
    each = rows.groupBy(*IN_SEGMENT).agg(summary.alias("summary"))
    by = Window.partitionBy("stream_id").orderBy("segment")
    frame = by.rowsBetween(1, Window.unboundedFollowing) if after else by.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each border that a stream crosses
    carry = each.withColumn("carried", fold.over(frame)).where(F.col("carried").isNotNull())
    carry = carry.select(F.col("stream_id").alias("c_stream"), F.col("segment").alias("c_segment"), "carried")
    same = F.col("stream_id").eqNullSafe(F.col("c_stream")) & (F.col("segment") == F.col("c_segment"))
    return rows.join(F.broadcast(carry), same, "left").drop("c_stream", "c_segment")


def running_sum(rows: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """``rows`` (of :func:`segmented`) with the sum of ``value`` up to each row, equal rows included."""
    within = Window.partitionBy(*IN_SEGMENT).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = _carried(rows, F.sum(value), F.sum("summary")).withColumn(name, F.sum(value).over(within))
    return local.withColumn(name, F.col(name) + F.coalesce("carried", F.lit(0))).drop("carried")


def sum_after(rows: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the stream's rows after each one."""
    within = Window.partitionBy(*IN_SEGMENT).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    local = _carried(rows, F.sum(value), F.sum("summary"), after=True).withColumn(name, F.sum(value).over(within))
    return local.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("carried", F.lit(0))).drop("carried")


def running_last(rows: DataFrame, value: Column, name: str, *order: str, before: bool = False) -> DataFrame:
    """``rows`` with the last ``value`` that isn't null up to each row, or ``before`` it."""
    within = Window.partitionBy(*IN_SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    at = F.when(value.isNotNull(), F.struct(*order))
    local = _carried(rows, F.max_by(value, at), F.last("summary", ignorenulls=True)).withColumn(name, F.last(value, ignorenulls=True).over(within))
    return local.withColumn(name, F.coalesce(name, "carried")).drop("carried")


def sessions(messages: DataFrame, starts: Column, ranges: int | None = None) -> DataFrame:
    """As :func:`scribewell.operators.state.sessions`."""
    rows = segmented(messages.withColumn("is_start", F.when(starts, 1).otherwise(0)), "ts", "seq", ranges=ranges)
    return running_sum(rows, "is_start", "session", "ts", "seq").drop("is_start", "segment")


def as_of(chunks: DataFrame, settings: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """As :func:`scribewell.operators.state.as_of`."""
    left = chunks.select("stream_id", "ts", "seq", F.lit(1).alias("kind"), F.lit(None).cast(settings.schema[value].dataType).alias(value))
    right = settings.select("stream_id", "ts", "seq", F.lit(0).alias("kind"), value)
    rows = segmented(left.unionByName(right), "ts", "kind", "seq", ranges=ranges)
    return running_last(rows, F.col(value), "found", "ts", "kind", "seq").where("kind = 1").select("stream_id", "ts", "seq", F.col("found").alias(value))


def paired(messages: DataFrame, pending: Column, ready: Column, closed: Column | None = None, ranges: int | None = None) -> DataFrame:
    """As :func:`scribewell.operators.state.paired`."""
    kind = F.when(pending, "pending").when(ready, "ready").when(F.lit(False) if closed is None else closed, "closed")
    rows = segmented(messages.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("stream_id", "ts", "seq", "kind"), "ts", "seq", ranges=ranges)
    both = running_last(rows, F.struct("kind", "seq"), "was", "ts", "seq", before=True)
    return both.where((F.col("kind") == "ready") & (F.col("was.kind") == "pending")).select("stream_id", F.col("was.seq").alias("pending_seq"), F.col("seq").alias("ready_seq"))


def recorder(messages: DataFrame, starts: Column, stops: Column, ranges: int | None = None) -> DataFrame:
    """As :func:`scribewell.operators.state.recorder`."""
    marked = messages.where(starts | stops).withColumn("state", F.when(starts, "recording").otherwise("idle")).select("stream_id", "ts", "seq", "state")
    both = running_last(segmented(marked, "ts", "seq", ranges=ranges), F.col("state"), "was", "ts", "seq", before=True)
    return both.where(F.col("state") != F.coalesce("was", F.lit("idle"))).select("stream_id", "ts", "seq", "state")


def trailing(events: DataFrame, seconds: int, ranges: int | None = None) -> DataFrame:
    """(stream_id, seq, n_trailing): for each event (stream_id, ts, seq) the count of its stream's events in the seconds up to it.

    The events up to it less those before its window begins: both are running counts, the second at a probe that stands at the window's begin.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    # a probe comes before the events of its time
    each = F.array(F.struct((2 * at + 1).alias("place"), F.lit(1).alias("n")), F.struct((2 * (at - seconds * 1_000_000)).alias("place"), F.lit(0).alias("n")))
    rows = events.select("stream_id", "seq", F.explode(each).alias("x")).select("stream_id", "seq", "x.place", "x.n")
    counted = running_sum(segmented(rows, "place", ranges=ranges), "n", "so_far", "place")
    return counted.groupBy("stream_id", "seq").agg(F.sum(F.when(F.col("n") == 1, F.col("so_far")).otherwise(-F.col("so_far"))).alias("n_trailing"))


def trailing_chunks(chunks: DataFrame, most: int, ranges: int | None = None) -> DataFrame:
    """As :func:`scribewell.operators.audio.trailing_chunks`."""
    sized = chunks.where(F.coalesce(F.size("samples") > 0, F.lit(False))).withColumn("n", F.size("samples").cast("long"))
    rows = sum_after(segmented(sized, "seq", ranges=ranges), "n", "n_after", "seq")
    return rows.where(F.col("n_after") < most).drop("n", "n_after", "segment")
