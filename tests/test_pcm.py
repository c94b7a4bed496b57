"""WAV chunks to samples of one rate: sines, all formats, and any chunk borders."""

import io
import tracemalloc
import wave

import numpy as np
import pytest

from scribewell.operators import pcm


def wav(samples, rate, width=2, channels=1):
    """A file by the standard library."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        whole = np.round(np.asarray(samples) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        if width == 1:
            data = (whole + 128).astype(np.uint8).tobytes()
        else:
            data = b"".join(int(x).to_bytes(width, "little", signed=True) for x in whole) if width == 3 else whole.astype(f"<i{width}").tobytes()
        f.writeframes(data)
    return out.getvalue()


def sine(rate, seconds, hertz):
    return 0.5 * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


def found(spark, files, cuts, **kwargs):
    """Samples of each file, cut into chunks at those bytes."""
    rows = []
    for stream, data in files.items():
        at = [0, *cuts, len(data)]
        rows += [(stream, k, data[a:b]) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    df = spark.createDataFrame(rows, "stream_id int, seq long, payload binary").repartition(3)
    out = {}
    for r in sorted(pcm.samples_of(df, **kwargs).collect(), key=lambda r: r["seq"]):
        out.setdefault(r["stream_id"], []).extend(r["samples"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("rate", [48_000, 44_100, 22_050, 8_000, 16_000])
def test_a_sine_stays_one(spark, rate):
    own = found(spark, {1: wav(sine(rate, 0.5, 1000), rate)}, [100, 4001, 4002, 9999], block=4096)[1]
    want = sine(16_000, 0.5, 1000)
    assert len(own) == len(want)
    assert np.abs(own - want)[200:-200].max() < 2e-3


def test_what_the_rate_cannot_hold_is_cut_off(spark):
    files = {1: wav(sine(48_000, 0.5, 12_000), 48_000), 2: wav(sine(48_000, 0.5, 12_000) + sine(48_000, 0.5, 500), 48_000)}
    own = found(spark, files, [5000])
    assert np.abs(own[1][200:-200]).max() < 5e-3
    assert np.abs(own[2] - sine(16_000, 0.5, 500))[200:-200].max() < 5e-3


def test_chunk_and_block_borders_change_nothing(spark):
    rng = np.random.default_rng(6)
    data = wav(rng.uniform(-1, 1, 9000), 44_100)
    whole = found(spark, {1: data}, [])[1]
    assert len(whole) == -(-9000 * 16_000 // 44_100)
    for cuts, block in (([44, 45, 47, 60, 61, 10_000], 1000), (sorted(rng.integers(1, len(data), 60).tolist()), 317), ([3, 20, 43], 64)):
        if cuts[0] < 44:
            # a header that is cut isn't one
            assert found(spark, {1: data}, cuts, block=block) == {}
            continue
        assert np.abs(found(spark, {1: data}, [c for c in cuts if c >= 44], block=block)[1] - whole).max() < 1e-6


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_widths_and_the_first_channel(spark, width):
    left, right = sine(16_000, 0.1, 300), sine(16_000, 0.1, 700)
    stereo = np.stack([left, right], axis=1).ravel()
    own = found(spark, {1: wav(stereo, 16_000, width, 2), 2: wav(left, 16_000, width)}, [50, 301])
    assert np.abs(own[1] - left).max() < (0.01 if width == 1 else 1e-4) and np.allclose(own[1], own[2])


def test_floats_and_further_chunks_of_a_header():
    import struct

    body = np.array([0.25, -0.5], "<f4").tobytes()
    fmt = struct.pack("<HHIIHH", pcm.EXTENDED, 1, 16_000, 64_000, 4, 32) + struct.pack("<HHI", 22, 32, 0) + struct.pack("<H", pcm.FLOAT) + b"\0" * 14
    data = b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body
    head = pcm.header(data)
    assert head == {"format": pcm.FLOAT, "channels": 1, "rate": 16_000, "bits": 32, "offset": len(data) - len(body)}
    assert pcm.decoded(data[head["offset"] :] + b"x", 3, 1, 32).tolist() == [0.25, -0.5]
    for bad in (b"", b"RIFF", data[:60].replace(b"WAVE", b"AVI "), data[:20]):
        assert pcm.header(bad) is None


def test_odd_chunks(spark):
    rows = [(1, 0, b"no header"), (2, 0, None), (2, 1, b""), (2, 2, wav([0.5, 0.25], 16_000)), (2, 3, b"\0"), (3, 0, wav([], 16_000)), (None, 0, wav([0.5], 16_000))]
    df = spark.createDataFrame(rows, "stream_id int, seq long, payload binary")
    own = {r["stream_id"]: [round(x, 3) for x in r["samples"]] for r in pcm.samples_of(df).collect()}
    assert own == {2: [0.5, 0.25]}
    assert pcm.samples_of(df.where("false")).count() == 0


def test_a_block_needs_little_memory_beside_its_samples():
    samples = np.random.default_rng(1).uniform(-1, 1, pcm.BLOCK)
    tracemalloc.start()
    out = pcm.resampled(samples, 0, 0, pcm.BLOCK, 48_000, 16_000)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(out) == 21_846 and most < 24 << 20
    # slices begin anywhere and change nothing
    halves = [pcm.resampled(samples, 0, a, b, 48_000, 16_000) for a, b in ((0, 3 * 5001), (3 * 5001, pcm.BLOCK))]
    assert (np.concatenate(halves) == out).all()
    assert len(pcm.resampled(samples, 0, 1, 2, 48_000, 16_000)) == 0
