"""Best-fit packing: documents' token pieces into sequences with token, document-count and attention-cost capacities.

Vector best-fit: of the open bins that hold a piece under every capacity, the one whose residual
vector is nearest to what the piece needs is taken, by the weighted norm of what would be left
(``score="norm"``) or by the weighted dot product of need and residual (``score="dot"``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .tokens import encoder

#: Pieces that one task packs together. Some bins of each such group stay partly empty, so larger is
#: tighter; a task needs some 100 bytes and up to a numpy pass over its open bins for each piece.
GROUP_PIECES = 16_384
#: Weights of the residual tokens, documents and attention cost in the choice of a bin.
WEIGHTS = (1.0, 1.0, 1.0)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: full ones, after a first that may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *[(a, capacity) for a in range(head, n, capacity)]] if n else []


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, piece, start, length, ids_crc32 of each piece of each text's ids followed by ``end_id``."""
    names = ["key", "piece", "start", "length", "ids_crc32"]

    def make():
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4")

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(encode(batch.column("text"))):
                data = memoryview(np.concatenate([ids.astype("<u4"), end]).tobytes())
                for piece, (start, length) in enumerate(cut(len(ids) + 1, capacity)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(data[4 * start : 4 * (start + length)]))
            columns = [batch.column("key").take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it for each piece, longest first. A piece needs (length, 1, length squared) of ``capacity``."""
    n = len(lengths)
    need = np.stack([lengths, np.ones(n), lengths.astype(np.float64) ** 2], axis=1) / capacity
    left = np.empty((max(n, 1), 3))
    used = np.zeros(max(n, 1), np.int64)
    bins, places = np.empty(n, np.int64), np.empty(n, np.int64)
    smallest = need.min(axis=0) if n else None
    is_open = np.empty(0, np.int64)
    opened = 0
    slack = 1e-12
    for i in np.argsort(-lengths, kind="stable").tolist():
        d = need[i]
        room = left[is_open]
        fits = np.nonzero((room >= d - slack).all(axis=1))[0]
        if len(fits):
            after = room[fits] - d
            best = (after * after @ weights).argmin() if score == "norm" else (room[fits] @ (weights * d)).argmin()
            b = is_open[fits[best]]
        else:
            b = opened
            left[b] = 1.0
            opened += 1
            is_open = np.append(is_open, b)
        bins[i], places[i] = b, used[b]
        used[b] += lengths[i]
        left[b] -= d
        if (left[b] < smallest - slack).any():  # nothing fits into it any more
            is_open = is_open[is_open != b]
    return bins, places


def pack(pieces: DataFrame, n: int, capacity: int, most_documents: int, attention: float, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", group: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (columns of :func:`token_pieces`, ``n`` rows) with sequence_id and offset.

    Rows are dealt round robin into groups of about ``group`` pieces, each packed by one task; hot
    keys don't matter, as no key deals the rows. Null and repeated keys are pieces like any other; no pieces give an empty table; further columns go through,
    but none called sequence_id or offset.
    """
    parts = max(1, -(-n // group))
    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", sequence_id long, offset long"
    caps, w = np.array([capacity, most_documents, attention], np.float64), np.array(weights, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [])
        bins, places = best_fit(table.column("length").to_numpy(), caps, w, score)
        out = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(places))
        yield from out.to_batches(max_chunksize=4096)

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next((b for b in batches if b.num_rows), None)
        if head is not None:
            yield from run(iter([head, *batches]))

    return pieces.repartition(parts).mapInArrow(guarded, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, most_documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> DataFrame:
    """Every piece of every document with its sequence: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then ``end_id``; null and empty texts are that one id. Documents
    longer than ``capacity`` are cut into full pieces and a first one that may be shorter. By default
    ``most_documents`` and ``attention`` (the sum of squared lengths in a sequence) have the largest
    values that a full sequence can need, so that no sequence is closed before its tokens are used up; what is left of them takes part in the choice all the same. A piece that alone is over the
    attention capacity has no sequence, which is an error. Repeated rows and null keys are packed like others; further columns are not
    read; an empty table gives an empty one.
    """
    attention = float(capacity) ** 2 if attention is None else float(attention)
    most_documents = capacity if most_documents is None else most_documents
    if min(capacity, most_documents) < 1 or attention < float(capacity) ** 2:
        raise ValueError("a full piece has to fit into an empty sequence")
    pieces = written(token_pieces(df, tokenizer_path, capacity, end_id, key, text), "pieces")
    n = pieces.where(F.col("length") < capacity).count()
    # a full piece is a sequence of its own, with a number that no group gives
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = full.unionByName(pack(pieces.where(F.col("length") < capacity), n, capacity, most_documents, attention, weights, score)) if n else full
    return out.withColumnRenamed("key", key)
