"""Folds by segments give what folds by stream give, where one stream has most of the rows, and no range gets much of it."""

import random

import pytest
from pyspark.sql import functions as F

from scribewell.operators import audio, segments, state


@pytest.fixture(scope="module")
def messages(spark):
    """A stream with two thirds of the rows, a null one, small ones, and many rows of one time."""
    rng = random.Random(4)
    rows = []
    for seq in range(3000):
        stream = 1 if seq % 3 else rng.choice([2, 3, 4, 5, None])
        rows.append((stream, seq, 1000 * (seq // rng.choice([1, 1, 40])), rng.choice(["start", "stop", "ready", "chunk", "chunk"]), rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(rows, "stream_id long, seq long, ms long, type string, value long").withColumn("ts", F.timestamp_millis("ms")).drop("ms").cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


RANGES = 16


def test_a_long_stream_is_dealt_out(messages):
    rows = segments.segmented(messages, "ts", "seq", ranges=RANGES)
    counts = sorted(r["count"] for r in rows.groupBy("segment").count().collect())
    assert len(counts) >= RANGES - 1 and counts[-1] <= 2 * counts[len(counts) // 2]
    assert rows.where("stream_id = 1").select("segment").distinct().count() >= RANGES // 2


def test_same_as_by_stream(messages):
    is_ = lambda *kinds: F.col("type").isin(*kinds)
    pairs = [
        (segments.sessions(messages, is_("start"), RANGES), state.sessions(messages, is_("start"))),
        (segments.paired(messages, is_("start"), is_("ready"), ranges=RANGES), state.paired(messages, is_("start"), is_("ready"))),
        (segments.paired(messages, is_("start"), is_("ready"), is_("stop"), RANGES), state.paired(messages, is_("start"), is_("ready"), is_("stop"))),
        (segments.recorder(messages, is_("start"), is_("stop"), RANGES), state.recorder(messages, is_("start"), is_("stop"))),
        (segments.as_of(messages.where(is_("chunk")), messages.where(is_("ready")), "value", RANGES), state.as_of(messages.where(is_("chunk")), messages.where(is_("ready")), "value").select("stream_id", "ts", "seq", "value")),
        (segments.trailing(messages, 30, RANGES), audio.trailing(messages, "stream_id").select("stream_id", "seq", "n_trailing")),
    ]
    for ours, by_stream in pairs:
        found = rows_of(ours)
        assert found and found == rows_of(by_stream.select(*ours.columns))


def test_sums_and_tails(messages):
    rows = segments.segmented(messages.select("stream_id", "ts", "seq", F.coalesce("value", F.lit(0)).alias("value")), "ts", "seq", ranges=RANGES)
    found = {r["seq"]: (r["up"], r["after"]) for r in segments.sum_after(segments.running_sum(rows, "value", "up", "ts", "seq"), "value", "after", "ts", "seq").collect()}
    streams = {}
    for r in sorted(rows.collect(), key=lambda r: (r["ts"], r["seq"])):
        streams.setdefault(r["stream_id"], []).append((r["seq"], r["value"]))
    expected = {}
    for own in streams.values():
        total, up = sum(v for _, v in own), 0
        for seq, v in own:
            up += v
            expected[seq] = (up, total - up)
    assert found == expected
    chunks = messages.select(F.col("stream_id").cast("int").alias("stream_id"), "seq", F.array_repeat(F.col("seq").cast("float"), F.coalesce("value", F.lit(0)).cast("int")).alias("samples"))
    for most in (1, 25, 100_000):
        assert rows_of(segments.trailing_chunks(chunks, most, RANGES)) == rows_of(audio.trailing_chunks(chunks, most))


def test_empty_tables(messages):
    none = messages.where("false")
    assert segments.sessions(none, F.lit(True)).count() == segments.trailing(none, 30).count() == segments.paired(none, F.lit(True), F.lit(False)).count() == 0
