"""Exact top-k by inner product with block-at-a-time pruning.

Documents are put in an order in which similar ones are near each other and cut into ranges (blocks). A
block's forward index is its matrix; its term maxima are the largest and, as weights may be negative,
the smallest value of each component. For a query the summed maxima bound every score in a block; blocks
are scored in the order of these bounds until the next bound is below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .vectors import blocks, clean, matrix, meet, ranked, top

#: Documents in a block, and in a part of the index.
BLOCK, GROUP = 64, 8192
#: Parts whose maxima stand in one row, and queries that do.
SUMMARIES, ASK_BLOCK = 2048, 1024
#: The floor of a query that has none yet: no long is smaller.
NO_FLOOR = -(2**63)
#: Random directions whose signs order the documents.
SIGNS = 12


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def bounds_of(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No inner product of a query with a row between ``low`` and ``high`` is larger: summed term maxima, and what rounding may have taken."""
    with np.errstate(over="ignore", invalid="ignore"):
        sums = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        return sums + 1e-12 * (np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T)


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, id, score) of each query's ``k`` best rows of ``x`` without its own id, and the number of blocks scored; ties to the smaller id.

    With ``floors`` rows of a smaller score than the query's floor are of no use, and neither are blocks that can't reach it.
    """
    n, dims = x.shape
    cuts = np.arange(0, n, block)
    high, low = np.maximum.reduceat(x, cuts), np.minimum.reduceat(x, cuts)
    exact = dims * max(np.abs(x).max(initial=0), 1.0) * max(np.abs(queries).max(initial=0), 1.0) < 2**53
    if not exact:  # beyond what doubles hold: Python's integers, and scores end at the largest long
        whole = x.astype(object)
        of = lambda rows, q: np.array([min(max(int(sum(int(a) * int(b) for a, b in zip(r, q, strict=True))), -(2**63)), 2**63 - 1) for r in whole[rows]], dtype=np.int64)
    bounds = bounds_of(queries, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    floors = np.full(len(queries), NO_FLOOR) if floors is None else floors
    out_q, out_v, out_s, scored = [], [], [], 0
    for i, (q, own) in enumerate(zip(queries, query_ids.tolist(), strict=True)):
        best_v, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step, floor = 0, 1, int(floors[i])
        while at < len(cuts):
            if exact and bounds[i, order[i, at]] < floor:
                break
            take = order[i, at : at + step]
            rows = (cuts[take][:, None] + np.arange(block)[None]).ravel()
            rows = rows[rows < n]
            scores = (x[rows] @ q).astype(np.int64) if exact else of(rows, q)
            other = (ids[rows] != own) & (scores >= floor)
            v, s = np.concatenate([best_v, ids[rows][other]]), np.concatenate([best_s, scores[other]])
            keep = top(v, s, k)
            best_v, best_s = v[keep], s[keep]
            if len(best_s) == k:
                floor = max(floor, int(best_s[-1]))
            at += len(take)
            scored += len(take)
            step = min(8, step * 2)
        out_q.append(np.full(len(best_v), own, np.int64))
        out_v.append(best_v)
        out_s.append(best_s)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s), scored


def forward_index(base: DataFrame, n: int, dims: int) -> DataFrame:
    """A written table (part, ids, data): the vectors in the order of the signs of their projections, GROUP to a part."""
    signs = np.random.default_rng(7).standard_normal((dims, SIGNS))

    def make():
        weights = 1 << np.arange(SIGNS)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            code = (matrix(batch.column("v"), dims) @ signs > 0) @ weights
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(code, pa.int64())], ["id", "v", "code"])

        return each

    coded = map_batches(base, make, "id long, v array<double>, code long")
    ordered = coded.repartitionByRange(max(1, -(-n // GROUP)), "code", "id").sortWithinPartitions("code", "id")
    return written(blocks(ordered, dims, GROUP).select((F.col("part") * (1 << 20) + F.col("piece")).alias("part"), "ids", "data"), "blocks")


def homes(documents: DataFrame) -> DataFrame:
    """(id, part) of every vector."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, ids in zip(batch.column("part").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(ids.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), part))], ["id", "part"])

        return each

    return map_batches(documents.select("part", "ids"), make, "id long, part long")


def promising(asked: DataFrame, n_asked: int, documents: DataFrame, dims: int, scale: float) -> DataFrame:
    """(part, query_id, v, floor): for each query (query_id, home, v, floor) the parts but its home whose summed term maxima reach its floor.

    Queries in rows of ASK_BLOCK meet the maxima of SUMMARIES parts at a time.
    """

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                x = scaled(np.frombuffer(data.as_py()).reshape(-1, dims), scale)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([x.max(axis=0).tolist()], pa.list_(pa.float64())), pa.array([x.min(axis=0).tolist()], pa.list_(pa.float64()))], ["part", "high", "low"])

        return each

    summaries = written(map_batches(documents.select("part", "data"), make, "part long, high array<double>, low array<double>"), "summaries")
    chunks = max(1, -(-summaries.count() // SUMMARIES))
    chunk = F.pmod(F.xxhash64("part"), F.lit(chunks)).cast("int")
    held = summaries.groupBy(chunk.alias("chunk")).agg(F.collect_list("part").alias("parts"), F.flatten(F.collect_list("high")).alias("high"), F.flatten(F.collect_list("low")).alias("low"))
    some = max(1, -(-n_asked // ASK_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(some)).cast("int")
    rows = asked.groupBy(block.alias("block")).agg(F.collect_list("query_id").alias("ids"), F.collect_list("home").alias("homes"), F.collect_list("floor").alias("floors"), F.collect_list("v").alias("vs"))
    both = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(held, "chunk")

    def reach():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                at = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                parts, high, low = at("parts").to_numpy(), at("high").to_numpy().reshape(-1, dims), at("low").to_numpy().reshape(-1, dims)
                ids, home, floors, vs = at("ids"), at("homes").to_numpy(), at("floors"), at("vs")
                q = scaled(matrix(vs, dims), scale)
                for a in range(0, len(ids), 64):
                    own = slice(a, a + 64)
                    reached = ~(bounds_of(q[own], high, low) < floors.to_numpy()[own, None]) & (home[own, None] != parts[None])
                    i, j = np.nonzero(reached)
                    take = pa.array(i + a)
                    yield pa.RecordBatch.from_arrays([pa.array(parts[j]), ids.take(take), vs.take(take), floors.take(take)], ["part", "query_id", "v", "floor"])

        return each

    return map_batches(both.select("parts", "high", "low", "ids", "homes", "floors", "vs"), reach, "part long, query_id long, v array<double>, floor long")


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` (of column id) holds, its ``k`` best other rows.

    First each query is answered by the part of the index that it lies in itself, whose k-th score is a floor for all others; then it goes
    to those parts only whose summed term maxima reach the floor, and in these to those blocks.

    A component x counts as floor(scale * x), scores are integer inner products, ties go to the smaller id. Rows with a null key,
    a null vector, or a null or non-finite component take no part; of rows that repeat a key the least vector does; shorter vectors are
    filled up with zeros; fewer candidates than k give them all; further columns are not read; an
    empty table gives an empty one. Scores beyond a long end at the largest long.
    """
    base = written(clean(df, key, vector), "vectors")
    n, dims = base.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    documents = forward_index(base, n, dims)
    home = homes(documents).where(is_query)
    asked = written(base.where(is_query).join(home, "id").select(F.col("id").alias("query_id"), F.col("part").alias("home"), "v"), "queries")

    def load(row: dict) -> dict:
        return {"x": scaled(np.frombuffer(row["data"]).reshape(-1, dims), scale), "ids": np.frombuffer(row["ids"], np.int64)}

    def answer(index: dict, batch: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return search_blocks(scaled(batch["v"], scale), batch["query_id"], index["x"], index["ids"], k, floors=np.array(batch["floor"], np.int64))[:3]

    # a part is home to no more queries than it has vectors
    near = meet(documents, asked.select(F.col("home").alias("part"), "query_id", "v", F.lit(NO_FLOOR).alias("floor")), GROUP, dims, load, answer, "long")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = written(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR))), "queries")
    n_asked = asked.count()
    far = meet(documents, promising(asked, n_asked, documents, dims, scale), n_asked, dims, load, answer, "long")
    return ranked(near.unionByName(far), k)
