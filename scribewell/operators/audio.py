"""Sample chunks of streams: concatenation, mixing, channels, trailing and leading windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Samples a second, seconds and samples of a window, and the hop between windows.
RATE, SECONDS = 16_000, 30
MOST = RATE * SECONDS
HOP = 10


def not_empty(samples: Column) -> Column:
    return F.coalesce(F.size(samples) > 0, F.lit(False))


def channel(channels: Column, n: int = 0) -> Column:
    """One channel of an array of channels; no downmix."""
    return F.try_element_at(channels, F.lit(n + 1))


def downmix(left: Column, right: Column) -> Column:
    """Two channels to one of the same power; null if either is missing."""
    return F.zip_with(left, right, lambda a, b: F.sqrt(F.lit(2.0)) * (a + b) / 2)


def mixed(a: Column, b: Column) -> Column:
    """Sample-wise sum; the shorter stream is silent at its end, a missing one all along."""
    empty = F.array().cast("array<double>")
    return F.zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def tail(samples: Column, most: int = MOST) -> Column:
    """The last ``most`` samples, or all if there are fewer."""
    return F.slice(samples, F.greatest(F.size(samples) - most, F.lit(0)) + 1, most)


def head(samples: Column, most: int = MOST) -> Column:
    return F.slice(samples, 1, most)


def trailing_chunks(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """The chunks of each stream that have any of its last ``most`` samples, by a window over sizes.

    Only sizes are summed, from the end; long streams shed all chunks before the window here, and so a stream's
    array stays bounded by ``most`` and one chunk whatever its length.
    """
    after = Window.partitionBy("stream_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    sized = chunks.where(not_empty(F.col("samples"))).withColumn("n_after", F.coalesce(F.sum(F.size("samples")).over(after), F.lit(0)))
    return sized.where(F.col("n_after") < most).drop("n_after")


def leading_chunks(chunks: DataFrame, most: int = MOST) -> DataFrame:
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = chunks.where(not_empty(F.col("samples"))).withColumn("n_before", F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0)))
    return sized.where(F.col("n_before") < most).drop("n_before")


def concatenated(chunks: DataFrame) -> DataFrame:
    """Each stream's samples in order, for chunks that are bounded by one of the windows or by a session."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "samples")))
    return chunks.groupBy("stream_id").agg(F.flatten(F.transform(ordered, lambda c: c["samples"])).alias("samples"))


def stream_tails(chunks: DataFrame, most: int = MOST) -> DataFrame:
    return concatenated(trailing_chunks(chunks, most)).withColumn("samples", tail(F.col("samples"), most))


def stream_heads(chunks: DataFrame, most: int = MOST) -> DataFrame:
    return concatenated(leading_chunks(chunks, most)).withColumn("samples", head(F.col("samples"), most))


def sliding(events: DataFrame, *keys: str, seconds: int = SECONDS, hop: int = HOP) -> DataFrame:
    """Count and sum of value in windows of ``seconds`` that begin each ``hop`` seconds; overlaps count in each."""
    window = F.window("ts", f"{seconds} seconds", f"{hop} seconds")
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("w_start"), *keys, "n", "total")


def trailing(events: DataFrame, key: str, seconds: int = SECONDS) -> DataFrame:
    """For each event the count of its key's events in the seconds up to it."""
    frame = f"count(*) OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"
    return events.withColumn("n_trailing", F.expr(frame))
