"""What the two vector searches share: clean vectors, and blocks of vectors that stand in one row each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Queries that one copy of a part answers.
ASK_ROWS = 8192
#: Tasks of the step in which queries meet parts, at most.
MOST_TASKS = 10_000


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row for each key, v an array of doubles; rows with a null key, a null vector or a null or non-finite component go.

    Of rows that repeat a key the least vector stays.
    """
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(good).select(F.col(key).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query: query_id, rank, vec_id, score; ties to the smaller vec_id. Each task keeps k of a query before rows are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id, in that order."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.nonzero(scores >= least)[0]
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def meet(parts: DataFrame, asked: DataFrame, n_queries: int, dims: int, load: Callable[[dict], dict], answer: Callable[[dict, dict], tuple[np.ndarray, np.ndarray, np.ndarray]], score: str) -> DataFrame:
    """A written table of the (query_id, vec_id, score) arrays that ``answer`` gives for what ``load`` makes of a part and for a batch of the queries that ask it.

    ``parts`` is a written table with a row for each part, ``asked`` has one for each query of a part: part, query_id, v and a further column. Queries come to the
    parts. No part has over ``n_queries`` of them; parts are repeated for each ASK_ROWS of these, so that a
    task has no more, whatever queries like; it holds one part at a time, and its queries pass by in batches.
    """
    spark = parts.sparkSession
    further = next(c for c in asked.columns if c not in ("part", "query_id", "v"))
    blobs = [c for c in parts.columns if c != "part"]
    ways = max(1, -(-n_queries // ASK_ROWS))
    dealt = parts.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    asking = asked.withColumn("way", F.pmod(F.xxhash64("query_id"), F.lit(ways)).cast("int"))
    kinds = {f.name: f.dataType for f in (*parts.schema.fields, *asked.schema.fields)}
    columns = [*blobs, "query_id", "v", further]
    side = lambda df, first: df.select("part", "way", F.lit(first).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    both = side(dealt, 0).unionByName(side(asking, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, way, kind = (batch.column(c).to_numpy() for c in ("part", "way", "kind"))
            cuts = np.nonzero((part[1:] != part[:-1]) | (way[1:] != way[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if kind[a] == 0:
                    now, at = load({c: batch.column(c)[a].as_py() for c in blobs}), (part[a], way[a])
                    continue
                if at != (part[a], way[a]):
                    raise RuntimeError("queries of a part that isn't there")
                own = batch.slice(a, b - a)
                q, v, s = answer(now, {"query_id": own.column("query_id").to_numpy(), "v": matrix(own.column("v"), dims), further: own.column(further).to_pylist()})
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64() if score == "long" else pa.float64())], ["query_id", "vec_id", "score"])
        pa.default_memory_pool().release_unused()

    small_batches(spark)
    # as many tasks as parts: a task's work is not in proportion to its bytes
    tasks = max(1, min(MOST_TASKS, ways * parts.count()))
    ordered = both.repartition(tasks, "part", "way").sortWithinPartitions("part", "way", "kind")
    return written(ordered.mapInArrow(run, f"query_id long, vec_id long, score {score}"), "scores")


def blocks(rows: DataFrame, dims: int, most: int, extra: str | None = None) -> DataFrame:
    """(part, piece, ids, data[, extra]): the rows (id, v[, extra]) of each partition, in their order, up to ``most`` to a row, as arrays in binary columns.

    ``part`` is the partition and ``piece`` counts its rows.
    """
    names = ["id", "v", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column("id").to_numpy(), matrix(batch.column("v"), dims), *([batch.column(extra).to_numpy()] if extra else [])])
            while sum(len(x[0]) for x in held) >= most:
                full = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield row(part, piece, [x[:most] for x in full])
                held, piece = [[x[most:] for x in full]], piece + 1
        if sum(len(x[0]) for x in held):
            yield row(part, piece, [np.concatenate(x) for x in zip(*held, strict=True)])

    def row(part: int, piece: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([piece], pa.int64()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays]], ["part", "piece", "ids", "data", *([extra] if extra else [])])

    small_batches(rows.sparkSession)
    schema = "part long, piece long, ids binary, data binary" + (f", {extra} binary" if extra else "")
    return rows.select(*names).mapInArrow(run, schema)
