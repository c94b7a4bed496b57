"""Audio files of plain samples: WAV chunks to samples of one rate, whatever borders the chunks have.

A stream's bytes are cut into blocks of a fixed number of frames, each with a margin on both sides, by their places in the
stream; a chunk gives a block the part that it has of it. So a block is decoded and resampled by itself, long streams lie in many
tasks, and what comes out doesn't depend on where chunks end.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribewell.operators.audio import RATE
from scribewell.operators.segments import running_sum, segmented
from scribewell.sources.scratch import small_batches

#: Frames of a block, and zero crossings of the filter to each side.
BLOCK, CROSSINGS = 1 << 16, 16
#: Samples that are filtered at once: each needs some 100 taps in several arrays.
AT_ONCE = 2048
#: Sample formats of a WAV file's header; the last says that the format stands further on.
INTEGER, FLOAT, EXTENDED = 1, 3, 0xFFFE
HEADER = "offset int, format int, channels int, rate int, bits int"


def header(data: bytes) -> dict | None:
    """Where samples begin in a WAV file and what they are; None for what is no such file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 24 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == EXTENDED and size >= 26 and at + 34 <= len(data):
                kind = struct.unpack_from("<H", data, at + 32)[0]
            sizes = (8, 16, 24, 32) if kind == INTEGER else (32, 64) if kind == FLOAT else ()
            found = {"format": kind, "channels": channels, "rate": rate, "bits": bits} if bits in sizes and channels and rate else None
        elif name == b"data":
            return found and found | {"offset": at + 8}
        at += 8 + size + size % 2
    return None


def headers(payload: Column) -> Column:
    @F.arrow_udf(f"struct<{HEADER.replace(' ', ':').replace(',:', ',')}>")
    def run(column: pa.Array) -> pa.Array:
        kind = pa.struct([(name, pa.int32()) for name in ("offset", "format", "channels", "rate", "bits")])
        return pa.array([None if x is None else header(x) for x in column.to_pylist()], kind)

    return run(payload)


def decoded(data: bytes, kind: int, channels: int, bits: int) -> np.ndarray:
    """The first channel's samples, from -1 to 1; a frame that is cut off is dropped."""
    width = bits // 8
    data = data[: len(data) - len(data) % (width * channels)]
    if kind == FLOAT:
        flat = np.frombuffer(data, f"<f{width}").astype(np.float64)
    elif bits == 8:
        flat = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        flat = np.frombuffer(data, f"<i{width}") / float(1 << (bits - 1))
    return flat[::channels]


def reach(rate: int, to: int) -> int:
    """Frames to each side that a sample of the new rate depends on."""
    return 0 if rate == to else int(np.ceil(CROSSINGS * max(1.0, rate / to))) + 1


def resampled(samples: np.ndarray, first: int, begin: int, end: int, rate: int, to: int) -> np.ndarray:
    """The samples at rate ``to`` whose times lie in the frames from ``begin`` to ``end``; ``samples`` begin at frame ``first`` and are silent beyond.

    A windowed sinc, which cuts off what the lower one of the rates can't hold.
    """
    if rate == to:
        return samples[begin - first : end - first]
    low, high = -(-begin * to // rate), -(-end * to // rate)
    cut, side = min(1.0, to / rate), reach(rate, to)
    offsets = np.arange(1 - side, side + 1)
    before = max(0, first - begin + 2 * side)
    padded = np.pad(samples, (before, 2 * side))
    parts = [np.zeros(0)]
    for a in range(low, high, AT_ONCE):
        out = np.arange(a, min(a + AT_ONCE, high))
        # exact in integers, so that every block places a sample at the same time
        whole, rest = out * rate // to, (out * rate % to) / to
        at = whole[:, None] + offsets[None] - first + before
        time = offsets[None] - rest[:, None]
        window = np.cos(np.pi / 2 * np.clip(time / side, -1, 1)) ** 2
        taps = cut * np.sinc(cut * time) * window
        taps /= taps.sum(axis=1, keepdims=True)
        parts.append((padded[np.clip(at, 0, len(padded) - 1)] * taps).sum(axis=1))
    return np.concatenate(parts)


def samples_of(chunks: DataFrame, to: int = RATE, block: int = BLOCK) -> DataFrame:
    """(stream_id, seq, samples): samples of the first channel at rate ``to`` of the streams whose WAV files ``chunks`` (stream_id, seq, payload) are cut into.

    A row for each block of a stream, ``seq`` counting them. A stream whose first chunk holds no WAV header (integers of 8 to 32 bits, floats of 32 or 64)
    gives nothing, nor do chunks of no stream; null and empty payloads are passed over; an incomplete last frame is dropped.
    """
    there = chunks.where(F.octet_length("payload") > 0).select("stream_id", "seq", "payload", F.octet_length("payload").cast("long").alias("size"))
    first = there.groupBy("stream_id").agg(F.min_by("payload", "seq").alias("head"))
    known = first.select("stream_id", headers(F.col("head")).alias("of")).where(F.col("of").isNotNull()).select("stream_id", "of.*")
    placed = running_sum(segmented(there, "seq"), "size", "upto", "seq").join(known, "stream_id")
    frame = (F.col("channels") * F.col("bits") / 8).cast("long")
    margin = F.when(F.col("rate") == to, 0).otherwise(F.ceil(CROSSINGS * F.greatest(F.lit(1.0), F.col("rate") / to)) + 2)
    placed = placed.withColumn("frame", frame).withColumn("margin", margin * frame).withColumn("long", F.lit(block) * frame)
    # bytes of samples that a chunk has, and the blocks that want any of them
    end, begin = F.col("upto") - F.col("offset"), F.col("upto") - F.col("size") - F.col("offset")
    bytes_ = placed.where(end > 0).withColumn("begin", F.greatest(begin, F.lit(0))).withColumn("end", end).withColumn("skip", F.greatest(-begin, F.lit(0)))
    blocks = F.sequence(F.greatest(F.expr("(begin - margin) div long"), F.lit(0)), F.expr("(end - 1 + margin) div long"))
    dealt = bytes_.withColumn("block", F.explode(blocks))
    low = F.greatest("begin", F.col("block") * F.col("long") - F.col("margin"))
    high = F.least("end", (F.col("block") + 1) * F.col("long") + F.col("margin"))
    parts = dealt.withColumn("low", low).withColumn("high", high).where("low < high")
    part = F.substring("payload", (F.col("skip") + F.col("low") - F.col("begin") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    whole = parts.groupBy("stream_id", "block", "format", "channels", "rate", "bits").agg(F.array_sort(F.collect_list(F.struct("low", part.alias("bytes")))).alias("parts"))

    @F.arrow_udf("array<float>")
    def run(number: pa.Array, kind: pa.Array, channels: pa.Array, rate: pa.Array, bits: pa.Array, parts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.float32)]
        # a block's bytes leave Arrow when it is its turn
        for k, f, c, r, b, one in zip(*[x.to_pylist() for x in (number, kind, channels, rate, bits)], parts, strict=True):
            own = one.as_py()
            samples = decoded(b"".join(p["bytes"] for p in own), f, c, b)
            start = own[0]["low"] // (c * b // 8)
            stop = min((k + 1) * block, start + len(samples))
            out.append(resampled(samples, start, k * block, stop, r, to).astype(np.float32) if stop > k * block else out[0])
        ends = np.cumsum([len(x) for x in out], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))

    small_batches(chunks.sparkSession)
    samples = run(F.col("block"), F.col("format"), F.col("channels"), F.col("rate"), F.col("bits"), F.col("parts"))
    return whole.select("stream_id", F.col("block").alias("seq"), samples.alias("samples")).where(F.size("samples") > 0)


def wav_chunks(chunks: DataFrame, rate: int) -> DataFrame:
    """(stream_id, seq, payload): chunks of samples as those of a WAV file of 16 bits for each stream; its first chunk has the header."""
    head = b"RIFF\xff\xff\xff\xffWAVEfmt " + struct.pack("<IHHIIHH", 16, INTEGER, 1, rate, 2 * rate, 2, 16) + b"data\xff\xff\xff\xff"

    @F.arrow_udf("binary")
    def run(samples: pa.Array, begins: pa.Array) -> pa.Array:
        encoded = [(np.clip(np.asarray(x.values, np.float64), -1, 32767 / 32768) * 32768).round().astype("<i2").tobytes() if x.is_valid else None for x in samples]
        return pa.array([x if x is None or not b else head + x for x, b in zip(encoded, begins.to_pylist(), strict=True)], pa.binary())

    first = chunks.where(F.size("samples") > 0).groupBy("stream_id").agg(F.min("seq").alias("first"))
    both = chunks.join(first, "stream_id")
    return both.select("stream_id", "seq", run(F.col("samples"), F.col("seq") == F.col("first")).alias("payload"))
