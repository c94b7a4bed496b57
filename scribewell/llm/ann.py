"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

A table hashes a unit vector by some Gaussian projections cut into cells of one width; a bucket is a tuple of
cells. A query visits buckets in the order of the estimated chance that a neighbour at its likely
nearness fell there, until the chances add up to a goal; the candidates of all tables are
merged and ranked by the exact cosine. Its likely cosine comes from a bounded sample of the vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, map_batches, salted_join, written
from .vectors import blocks, clean, matrix, meet, ranked, top

#: Tables, and the cells' width in standard deviations of a projection.
TABLES, WIDTH = 2, 2.0
#: The chance to meet a neighbour that queries aim at, over all tables.
GOAL = 0.97
#: Vectors of the sample that distances are estimated from, about; at most twice as many.
SAMPLE = 2048
#: Vectors in a bucket, about: more vectors take more projections, up to MOST_BITS / 4.
OCCUPANCY = 64
#: Vectors in a part of the index, and queries that one task finds places for, about.
INDEX_ROWS, QUERY_ROWS = 4096, 1024
#: A cell has four bits in a bucket's number.
LOW, HIGH, MOST_PROJECTIONS = -8, 7, 15


class Tables:
    """Projections and offsets of each table; the same for the same arguments."""

    def __init__(self, dims: int, projections: int, tables: int = TABLES, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width, self.projections, self.tables = width, projections, tables
        self.a, self.b = [], []
        for _ in range(tables):
            a = rng.standard_normal((dims, max(projections, 1)))
            # orthogonal directions tell more than independent ones; a projection of a unit vector has variance 1 / dims
            self.a.append(np.linalg.qr(a)[0][:, :projections] * math.sqrt(dims))
            self.b.append(rng.uniform(0, width, projections))

    def cells(self, u: np.ndarray, table: int, nearness: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Cells of unit vectors, and where in its cell each lies.

        With ``nearness`` they are those of the mean of unit vectors that have this cosine with ``u``: such a vector
        is that many parts ``u`` and else at random, so its projection is drawn towards 0.
        """
        at = ((u @ self.a[table]) * np.reshape(nearness, (-1, 1)) + self.b[table]) / self.width
        cell = np.clip(np.floor(at), LOW, HIGH)
        return cell.astype(np.int64), at - cell

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        shifts = 4 * np.arange(self.projections, dtype=np.int64)
        return ((cells - LOW) << shifts).sum(axis=-1).astype(np.int64)


def chances(inside: np.ndarray, spread: float, reach: int = 2) -> np.ndarray:
    """For each projection the chance that a neighbour lies 2 cells below to 2 above, its difference being normal with ``spread``, in cells."""
    edges = np.arange(-reach, reach + 2)[None] - inside[:, None]
    erf = np.vectorize(math.erf, otypes=[float])
    cdf = 0.5 * (1 + erf(edges / (spread * math.sqrt(2)))) if spread > 0 else (edges > 0).astype(float)
    out = np.diff(cdf, axis=1)
    out[:, 0] += cdf[:, 0]  # what lies beyond
    out[:, -1] += 1 - cdf[:, -1]
    return out


def probes(cells: np.ndarray, inside: np.ndarray, spread: float, goal: float, reach: int = 2) -> list[tuple[int, ...]]:
    """Tuples of cells, likeliest first, until their chances add up to ``goal``."""
    m = len(cells)
    if not m:
        return [()]
    p = chances(inside, spread, reach)
    order = np.argsort(-p, axis=1)
    logs = [[math.log(max(p[i, j], 1e-300)) for j in order[i]] for i in range(m)]
    steps = [[(int(cells[i]) + int(j) - reach) for j in order[i]] for i in range(m)]
    # best first: each tuple of ranks is made from one parent, by raising the last raised position or a later one
    heap = [(-sum(x[0] for x in logs), (0,) * m, 0)]
    out, met = [], 0.0
    while heap and met < goal:
        cost, ranks, last = heapq.heappop(heap)
        chance = math.exp(-cost)
        if chance < 1e-9:
            break
        met += chance
        found = tuple(s[r] for s, r in zip(steps, ranks, strict=True))
        if all(LOW <= c <= HIGH for c in found):
            out.append(found)
        for i in range(last, m):
            r = ranks[i]
            if r + 1 < len(logs[i]):
                heapq.heappush(heap, (cost + logs[i][r] - logs[i][r + 1], (*ranks[:i], r + 1, *ranks[i + 1 :]), i))
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Scaled in two steps, so that neither very large nor very small components are lost."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal vectors have equal scores."""
    big = np.abs(x).max(axis=1)
    x, q = x / big[:, None], q / np.abs(q).max()
    return np.clip((x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt((q * q).sum())), -1.0, 1.0)


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, goal: float = GOAL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` (of column id) holds, the ``k`` nearest other rows found by cosine.

    Rows with a null key, a null or zero vector, or a null or non-finite component take no part; of rows that repeat a key the least
    vector does; shorter vectors are filled up with zeros; up to OCCUPANCY vectors are one bucket, so that
    all are candidates; ties go to the smaller id; further columns are not read; an empty table gives an empty one.
    """
    base = written(clean(df, key, vector).where(F.exists("v", lambda x: x != 0)), "vectors")
    n, dims = base.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    projections = min(MOST_PROJECTIONS, dims, max(0, round(math.log(max(n, 1) / OCCUPANCY, 3)) if n > OCCUPANCY else 0))
    hashes = Tables(dims, projections, tables)
    packed = index(base, n, dims, hashes)
    asked = base.where(is_query)
    visits = written(visited(asked, n, k, dims, hashes, goal, sample_of(base, n, dims)), "visits")
    return ranked(answers(packed, asks(asked, visits, places(packed)), asked.count(), dims, k).distinct(), k)


def sample_of(base: DataFrame, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a sample by a hash of the id: about SAMPLE rows, and never over twice as many."""
    rows = base.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).collect()
    ids, v = np.array([r["id"] for r in rows], np.int64), np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        v[i, : len(r["v"])] = r["v"]
    return ids, unit(v) if len(rows) else v


def index(base: DataFrame, n: int, dims: int, hashes: Tables) -> DataFrame:
    """A written table (part, ids, data, keys): each vector once for each table, in the order of its place (table and bucket).

    A part is a piece of one range of places, of no more than INDEX_ROWS vectors; a place of many vectors goes over several parts, as ids break the ties.
    """
    tables = hashes.tables

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            u = unit(matrix(batch.column("v"), dims))
            every = [place_of(t, hashes.bucket(hashes.cells(u, t)[0])) for t in range(tables)]
            rows = pa.array(np.tile(np.arange(batch.num_rows), tables))
            return pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("v").take(rows), pa.array(np.concatenate(every))], ["id", "v", "place"])

        return each

    hashed = map_batches(base, make, "id long, v array<double>, place long")
    ordered = hashed.repartitionByRange(max(1, -(-n * tables // INDEX_ROWS)), "place", "id").sortWithinPartitions("place", "id")
    numbered = blocks(ordered, dims, INDEX_ROWS, "place").select((F.col("part") * (1 << 20) + F.col("piece")).alias("part"), "ids", "data", F.col("place").alias("keys"))
    return written(numbered, "index")


def place_of(table: int, bucket: np.ndarray) -> np.ndarray:
    """Table and bucket as one number: a bucket has 60 bits at most."""
    return bucket | np.int64(table << 60)


def places(packed: DataFrame) -> DataFrame:
    """(place, parts): the parts that each place of the index is in."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, keys in zip(batch.column("part").to_pylist(), batch.column("keys"), strict=True):
                own = np.unique(np.frombuffer(keys.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), part))], ["place", "part"])

        return each

    return map_batches(packed.select("part", "keys"), make, "place long, part long").groupBy("place").agg(F.collect_list("part").alias("parts"))


def visited(asked: DataFrame, n: int, k: int, dims: int, hashes: Tables, goal: float, sample: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(query_id, place): the places that each query visits."""
    s_ids, s_units = sample
    # in the sample the k-th neighbour of all is about the first
    rank = max(1, math.ceil(k * len(s_ids) / max(n, 1)))
    per_table = 1 - (1 - goal) ** (1 / hashes.tables)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("id").to_numpy()
            u = unit(matrix(batch.column("v"), dims))
            near = u @ s_units.T if len(s_ids) else np.zeros((len(ids), 1))
            if len(s_ids):
                near[ids[:, None] == s_ids[None]] = 0.0
            least = max(0, near.shape[1] - rank)
            near = np.clip(np.partition(near, least, axis=1)[:, least], 0.0, 1.0)
            spread = np.sqrt(np.maximum(1 - near**2, 1e-12)) / hashes.width
            rows, found = [], []
            for t in range(hashes.tables):
                cells, inside = hashes.cells(u, t, near)
                for i in range(len(ids)):
                    tuples = probes(cells[i], inside[i], float(spread[i]), per_table)
                    found.append(place_of(t, hashes.bucket(np.array(tuples, np.int64).reshape(len(tuples), hashes.projections))))
                    rows.append(np.full(len(tuples), i))
            return pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(rows)]), pa.array(np.concatenate(found))], ["query_id", "place"])

        return each

    return map_batches(asked.repartition(max(1, -(-n // (16 * QUERY_ROWS)), base_parallelism(asked))), make, "query_id long, place long")


def base_parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def asks(asked: DataFrame, visits: DataFrame, where: DataFrame) -> DataFrame:
    """(part, query_id, v, visited): each query once for each part that has a place it visits, with its vector and those places.

    The places' parts are joined to the visits, salted for places that very many queries visit.
    """
    hot = hot_keys(visits.groupBy("place").agg(F.count("*").alias("n")), "place", "n", visits.count())
    at = salted_join(visits, where, "place", hot, "query_id").where(F.col("parts").isNotNull())
    by_query = at.withColumn("part", F.explode("parts")).groupBy("query_id").agg(F.collect_list(F.struct("part", "place")).alias("stops"))
    both = by_query.join(asked.select(F.col("id").alias("query_id"), "v"), "query_id")
    each = both.withColumn("part", F.explode(F.array_distinct(F.col("stops.part"))))
    return each.select("part", "query_id", "v", F.transform(F.filter("stops", lambda x: x["part"] == F.col("part")), lambda x: x["place"]).alias("visited"))


def answers(packed: DataFrame, asked: DataFrame, n_queries: int, dims: int, k: int) -> DataFrame:
    """A written table (query_id, vec_id, score): the ``k`` nearest to each query of each part that it asks."""

    def answer(index: dict, batch: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x, units, runs = index["ids"], index["x"], index["units"], index["runs"]
        q_units = unit(batch["v"])
        out = []
        for i, (q, own) in enumerate(zip(batch["query_id"].tolist(), batch["visited"], strict=True)):
            spans = [runs[p] for p in own if p in runs]
            rows = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
            rows = rows[ids[rows] != q]
            if not len(rows):
                continue
            rough = units[rows] @ q_units[i]
            if len(rows) > 2 * k:
                least = np.partition(rough, len(rough) - 2 * k)[len(rough) - 2 * k] - 1e-9
                rows = rows[rough >= least]
            exact = cosines(x[rows], batch["v"][i])
            # the same vector may stand here for two tables
            first = np.unique(ids[rows], return_index=True)[1]
            rows, exact = rows[first], exact[first]
            best = top(ids[rows], exact, k)
            out.append((np.full(len(best), q), ids[rows][best], exact[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def load(row: dict) -> dict:
        ids, x, keys = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"]).reshape(-1, dims), np.frombuffer(row["keys"], np.int64)
        cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        return {"ids": ids, "x": x, "units": unit(x), "runs": {int(keys[a]): (a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}}

    return meet(packed, asked, n_queries, dims, load, answer, "double")
