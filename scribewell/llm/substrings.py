"""Substring dedup: words in passages that a document with a smaller key has too are removed.

Seed and extend. Of each window of consecutive words the least hash of its shorter word runs is its anchor, so
equal windows have equal anchors (winnowing). Documents meet on anchors that more than one of them has; from there the
windows around an anchor are the ways in which it extends to both sides, and those that begin in a
document with a smaller key are kept. Windows that follow each other make up the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, map_batches, small_batches, written

#: Fixed value: words of a window.
WINDOW = 13
#: Words of a run whose hash may be an anchor.
SEED_WORDS = 5
#: Words that a task looks at together, about: copies in these are settled before anything is shuffled.
CHUNK_WORDS = 1 << 20
#: Windows of a bucket, about.
BUCKET_WINDOWS = 1 << 19
#: Bits of the filter of shared anchors for each of them, and at most. Beyond that more anchors pass than are shared, and results stay the same.
BITS_EACH, BITS_MOST = 16, 1 << 28
#: What stands for a null key: no document has a greater one.
LAST = (1 << 63) - 1
_SEED, _RUN, _WHOLE = 42, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The XXH64 of each word; each distinct one is hashed once."""
    import xxhash

    coded = pa.array(words, pa.binary()).dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def rolled(hashes: np.ndarray, words: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``words`` words."""
    n = max(0, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for j in range(words):
        out *= base
        out += hashes[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class Windows:
    """All windows of some documents: the documents and words at which they begin, their hashes and those of their anchors, and where these stand."""

    def __init__(self, texts: list[bytes], window: int, seed: int):
        split = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        hashes = word_hashes([w for own in split for w in own])
        doc = np.repeat(np.arange(len(split)), sizes)
        self.n = int(sizes.sum())
        starts = np.arange(max(0, self.n - window + 1))
        runs = rolled(hashes, seed, _RUN)
        least, place = runs[: len(starts)].copy(), np.zeros(len(starts), np.int64)
        for j in range(1, window - seed + 1):
            other = runs[j : j + len(starts)]
            lower = other <= least  # the last of equal ones
            least[lower], place[lower] = other[lower], j
        inside = doc[: len(starts)] == doc[window - 1 :] if len(starts) else np.zeros(0, bool)
        self.start, self.doc = starts[inside], doc[: len(starts)][inside]
        self.at, self.anchor, self.hash = (starts + place)[inside], least[inside], rolled(hashes, window, _WHOLE)[inside]
        self.word = self.start - (np.cumsum(sizes) - sizes)[self.doc]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts, keys and versions of about CHUNK_WORDS words at a time (six bytes count as a word)."""
    texts, ids, versions, size = [], [], [], 0
    for batch in batches:
        for text, i, version in zip(batch.column("text").cast(pa.binary()), batch.column("id").to_pylist(), batch.column("version").to_pylist(), strict=True):
            texts.append(text.as_py() or b"")
            ids.append(i)
            versions.append(version)
            size += len(texts[-1])
            if size > 6 * CHUNK_WORDS:
                yield texts, np.array(ids, np.int64), np.array(versions, np.int64)
                texts, ids, versions, size = [], [], [], 0
    if texts:
        yield texts, np.array(ids, np.int64), np.array(versions, np.int64)
    pa.default_memory_pool().release_unused()


def seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, low, high, n): the anchors of ``docs`` with the least and greatest key of a document that has it, and how often it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, _ in chunks(batches):
            w = Windows(texts, window, seed)
            _, first = np.unique(w.at, return_index=True)
            anchor, key = w.anchor[first], ids[w.doc[first]]
            order = np.lexsort((key, anchor))
            anchor, key = anchor[order], key[order]
            begin = np.nonzero(np.concatenate([np.ones(min(1, len(anchor)), bool), anchor[1:] != anchor[:-1]]))[0]
            end = np.concatenate([begin[1:], [len(anchor)]])[: len(begin)]
            columns = [anchor[begin].view(np.int64), key[begin], key[end - 1], end - begin]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "low", "high", "n"])

    small_batches(docs.sparkSession)
    own = docs.mapInArrow(run, "anchor long, low long, high long, n long")
    return own.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def bit_filter(anchors: DataFrame, n: int) -> np.ndarray:
    """A bit for each prefix of a hash, set for those of the ``n`` anchors: BITS_EACH bits for each, at most BITS_MOST in all.

    A task sets the bits of a range of prefixes, so the driver gets each byte of the filter once.
    """
    bits = int(min(BITS_MOST, max(1 << 16, 1 << int(np.ceil(np.log2(max(1, n) * BITS_EACH))))))
    at = F.expr(f"shiftrightunsigned(anchor, {64 - (bits.bit_length() - 1)})")

    def put(own: pa.Table) -> pa.Table:
        flags = np.zeros(1 << 16, bool)
        flags[own.column("bit").to_numpy() & 0xFFFF] = True
        return pa.table({"part": pa.array([own.column("part")[0].as_py()], pa.int64()), "data": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    parts = anchors.select(at.alias("bit")).withColumn("part", F.expr("shiftrightunsigned(bit, 16)"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("part").applyInArrow(put, "part long, data binary").toLocalIterator():
        out[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["data"], np.uint8)
    return out


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def later(key: np.ndarray, check: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of windows, which equal one of a smaller key."""
    order = np.lexsort((key, check, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (check[order][1:] == check[order][:-1])
    begin = np.concatenate([np.ones(min(1, len(order)), bool), ~same])
    least = key[order][begin][np.cumsum(begin) - 1]
    out = np.zeros(len(order), bool)
    out[order] = key[order] > least
    return out


def _packed(doc: np.ndarray, word: np.ndarray, ids: np.ndarray, versions: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """The windows that begin at ``word`` of ``doc``, by groups of documents: one row for each group."""
    group = versions[doc] % groups
    order = np.lexsort((word, doc, group))
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    for k in np.nonzero(np.diff(cuts))[0].tolist():
        at = order[cuts[k] : cuts[k + 1]]
        own, n = np.unique(doc[at], return_counts=True)
        arrays = [np.array([len(own), len(at)], "<i8"), ids[own], versions[own], n.astype("<i4"), word[at].astype("<i4")]
        yield k, b"".join(x.tobytes() for x in arrays)


def _unpacked(blob: bytes, kinds: tuple[str, ...], of_doc: int) -> list[np.ndarray]:
    """Arrays of ``kinds``: the first ``of_doc`` have one value for each document, the others one for each window."""
    n = np.frombuffer(blob, "<i8", 2).tolist()
    at, out = 16, []
    for k, kind in enumerate(kinds):
        out.append(np.frombuffer(blob, kind, n[k >= of_doc], at))
        at += out[-1].nbytes
    return out


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "data"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each bucket with all of its rows, which stand together."""
    now, held = -1, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(blob.as_py())
    if held:
        yield now, held
    pa.default_memory_pool().release_unused()


def repeated(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(id, version, starts): of documents (id, version, text) the windows that begin in a document with a smaller id too; ``starts`` are their first words as 32-bit integers.

    A chunk of texts settles its own windows first, so of a window a chunk sends no more than what its least document has; anchors with over
    HOT_SHARE of all occurrences are dealt out by the whole window.
    """
    spark = docs.sparkSession
    shared = written(seeds(docs, window, seed).where("low < high").select("anchor", "n"), "shared_anchors")
    n, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = spark.sparkContext.broadcast(bit_filter(shared, n))
    hot = np.array([r["anchor"] for r in shared.where(F.col("n") >= max(1000, int(total * HOT_SHARE))).select("anchor").collect()], np.int64).view(np.uint64)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, int(total * (window - seed + 2) / 2 / BUCKET_WINDOWS))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, versions in chunks(batches):
            w = Windows(texts, window, seed)
            keep = passes(w.anchor, bits.value)
            doc, word, anchor, hashes = w.doc[keep], w.word[keep], w.anchor[keep], w.hash[keep]
            del w
            check = anchor.astype(np.uint32)
            gone = later(ids[doc], check, hashes)
            # what is settled goes on to the documents, behind the buckets
            rows = [(buckets + k, x) for k, x in _packed(doc[gone], word[gone], ids, versions, buckets)]
            doc, word, anchor, hashes, check = (x[~gone] for x in (doc, word, anchor, hashes, check))
            dealt = np.where(np.isin(anchor, hot), hashes, anchor) >> np.uint64(32)
            dealt = (dealt * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(dealt, kind="stable")
            cuts = np.searchsorted(dealt[order], np.arange(buckets + 1, dtype=np.uint64))
            for k in np.nonzero(np.diff(cuts))[0].tolist():
                at = order[cuts[k] : cuts[k + 1]]
                own, place = np.unique(doc[at], return_inverse=True)
                # differences are small, and so are packed well
                arrays = [np.array([len(own), len(at)], "<i8"), ids[own], versions[own], hashes[at], np.diff(place, prepend=0).astype("<i4"), np.diff(word[at], prepend=0).astype("<i4"), check[at]]
                rows.append((k, b"".join(x.tobytes() for x in arrays)))
            yield _rows(rows)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            if bucket >= buckets:
                yield _rows([(bucket - buckets, x) for x in blobs])
                continue
            parts, base = [], 0
            for blob in blobs:
                own = _unpacked(blob, ("<i8", "<i8", "<u8", "<i4", "<i4", "<u4"), 2)
                parts.append([*own[:3], np.cumsum(own[3]) + base, np.cumsum(own[4]), own[5]])
                base += len(own[0])
            ids, versions, hashes, doc, word, check = (np.concatenate(x) for x in zip(*parts, strict=True))
            gone = later(ids[doc], check, hashes)
            yield _rows(list(_packed(doc[gone], word[gone], ids, versions, buckets)))

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document."""
        for _, blobs in _by_bucket(batches):
            ids, versions, n, word = (np.concatenate(x) for x in zip(*[_unpacked(b, ("<i8", "<i8", "<i4", "<i4"), 3) for b in blobs], strict=True))
            order = np.lexsort((word, np.repeat(versions, n), np.repeat(ids, n)))
            ids, versions, word = np.repeat(ids, n)[order], np.repeat(versions, n)[order], word[order]
            begin = np.nonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])]))[0]
            end = [*begin[1:].tolist(), len(word)]
            starts = [word[a:b].tobytes() for a, b in zip(begin.tolist(), end, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(versions[begin]), pa.array(starts, pa.binary())], ["id", "version", "starts"])

    small_batches(spark)
    shape, n_tasks = "bucket long, data binary", max(tasks, min(buckets, 10_000))
    dealt = docs.mapInArrow(meet, shape).repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
    replies = dealt.mapInArrow(settle, shape).repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
    return replies.mapInArrow(collected, "id long, version long, starts binary")


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """``df`` with n_words, n_removed, removed and kept: of every row's words (runs of anything but ASCII white space) those are removed that a window of ``window`` words covers which begins in a row with a smaller key too.

    ``removed`` has the maximal runs of removed words as (start, end), the end exclusive, and ``kept`` is the words that are left, joined by one space.
    Windows are judged on what is given, not on what is left. Rows of equal keys take nothing from each other; a null key counts as the
    greatest; a null or empty text has no words and an empty ``kept``; texts of fewer words than a window keep all; an empty table gives an empty
    one. Columns of ``df`` with the names of new ones are replaced; the key has to be an integer.
    """
    if not 0 < seed <= window:
        raise ValueError("an anchor has between one word and all of a window")
    named = df.withColumn("__sw_id", F.coalesce(F.col(key).cast("long"), F.lit(LAST))).withColumn("__sw_version", F.xxhash64(text))
    docs = named.select(F.col("__sw_id").alias("id"), F.col("__sw_version").alias("version"), F.col(text).alias("text"))
    gone = repeated(docs, window, seed)
    gone = gone.select(F.col("id").alias("__sw_id"), F.col("version").alias("__sw_version"), F.col("starts").alias("__sw_starts"))
    new = {"n_words": "long", "n_removed": "long", "removed": "array<struct<start:long,end:long>>", "kept": "string"}
    names = [c for c in df.columns if c not in new]
    # the text may be a column that is replaced
    both = named.withColumn("__sw_text", F.col(text)).join(gone, ["__sw_id", "__sw_version"], "left").select(*names, "__sw_text", "__sw_starts")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_removed, removed, kept = [], [], [], []
            for x, starts in zip(batch.column("__sw_text").cast(pa.binary()), batch.column("__sw_starts"), strict=True):
                words = words_of(x.as_py() or b"")
                spans = []
                if starts.is_valid:
                    # where windows begin and end add up to how many cover a word
                    cover = np.zeros(len(words) + 1, np.int64)
                    start = np.unique(np.frombuffer(starts.as_py(), "<i4"))
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + window, -1)
                    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
                    spans = list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in spans))
                removed.append([{"start": a, "end": b} for a, b in spans])
                left = [w for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(words)], strict=True) for w in words[a:b]] if spans else words
                kept.append(b" ".join(left))
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], [*names, *new])

        return each

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"{c} {kind}" for c, kind in new.items()])
    return map_batches(both, make, schema)
