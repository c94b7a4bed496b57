"""Vector code compression: vectors as short codes of entries of learned codebooks.

A vector's components become integers, and it is cut into equal parts. Equal parts of one position are one
weighted row, so that copies cost nothing; Lloyd's rounds go over these distinct rows only, with the codebooks sent to
the tasks and sums of a bounded size sent back; at the end each distinct row's code and error are joined back to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, checked, map_batches, small_batches, written

# Parts of a vector, entries of a part's codebook, rounds of Lloyd's, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256.0
#: Components beyond this become this, so that squared distances and weighted sums fit in 64 bits.
LARGEST = 1 << 26


def integers(vector: Column, factor: float = FACTOR) -> Column:
    """floor(factor * x) of every component x, between -LARGEST and LARGEST."""
    whole = lambda x: F.greatest(F.least(F.floor(x.cast("double") * factor), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def nearest(position: np.ndarray, points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point of a position the index of the nearest entry of its codebook, ties to the lower one, and the squared distance; exact in integers."""
    distance = np.zeros((len(points), books.shape[1]), np.int64)
    for j in range(points.shape[1]):
        apart = points[:, j, None] - books[position, :, j]
        distance += apart * apart
    code = distance.argmin(axis=1)
    return code, distance[np.arange(len(code)), code]


def _points(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("pos").to_numpy(), batch.column("part").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _sums(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, entry, place, total, n): weighted sums of the components of the points that are nearest to each entry; a task gives one row at most for each component of an entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                position, points = _points(batch, width)
                weight = batch.column("n").to_numpy()
                code, _ = nearest(position, points, books)
                np.add.at(total, (position, code), points * weight[:, None])
                np.add.at(count, (position, code), weight)
        pos, entry = np.nonzero(count)
        columns = [np.repeat(pos, width), np.repeat(entry, width), np.tile(np.arange(width), len(pos)), total[pos, entry].ravel(), np.repeat(count[pos, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["pos", "entry", "place", "total", "n"])

    small_batches(distinct.sparkSession)
    sums = distinct.mapInArrow(run, "pos long, entry long, place long, total long, n long")
    return sums.groupBy("pos", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` of Lloyd's over weighted ``distinct`` (pos, part, n); means are rounded down, and entries without points stay.

    The driver gets a row for each component of an entry, however many vectors there are.
    """
    for _ in range(rounds):
        books = books.copy()
        for r in _sums(distinct, books).collect():
            books[r["pos"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, part, n, code, apart): ``distinct`` with the nearest entry and the squared distance to it."""
    width = books.shape[2]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            code, apart = nearest(*_points(batch, width), books)
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("pos", "part", "n")], pa.array(code, pa.int32()), pa.array(apart, pa.int64())], ["pos", "part", "n", "code", "apart"])

        return each

    return map_batches(distinct.select("pos", "part", "n"), make, "pos int, part array<int>, n long, code int, apart long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: float = FACTOR) -> DataFrame:
    """``key``, code, error, label_error, codebooks_sha256 of every row of ``df`` whose vector is neither null nor has null or non-finite components.

    ``code`` has two hex digits for each part, ``error`` is the sum of squared distances in integers, and ``label_error`` the sum of the
    errors of rows of equal ``label``, null labels together. A codebook begins as the parts of the ``entries`` smallest keys (null last, ties by the
    integer vector); with fewer rows it has fewer entries. Repeated rows count and come back each; shorter vectors
    are filled up with zeros to the longest one, and this to a multiple of ``parts``; components beyond 2^26 after
    ``factor`` count as that; an empty table gives an empty one; further columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits tell 256 entries apart")
    spark = df.sparkSession
    kinds = {name: df.schema[c].dataType.simpleString() for name, c in (("key", key), ("label", label))}
    rows = df.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(label).alias("label"), integers(F.col(vector), factor).alias("ints"))
    # numbers of rows are read from the table, so all readers see the same
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], f"`{key}` {kinds['key']}, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-longest // parts))
    filled = F.concat("ints", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("ints")))
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("filled", p * width + 1, width))).alias("pos", "part")
    exploded = rows.withColumn("filled", filled).select("row", cut)
    # copies are added up in each task before they are shuffled
    distinct = written(exploded.groupBy("pos", "part").agg(F.count("*").alias("n")), "distinct_parts")
    first = rows.withColumn("filled", filled).orderBy(F.asc_nulls_last("key"), "filled").limit(entries).select("filled").collect()
    books = np.array([r["filled"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = lloyd(distinct, books, rounds)
    coded = written(assigned(distinct, books), "assigned_parts")
    # at most 1 / HOT_SHARE of a position: these go to all tasks, so that no task gets all rows of one
    is_hot = F.col("n") >= max(2, int(total * HOT_SHARE))
    hot = F.broadcast(coded.where(is_hot).drop("n"))
    cold = coded.where(~is_hot).drop("n")
    names = ["row", "pos", "code", "apart"]
    looked = exploded.join(hot, ["pos", "part"], "left")
    back = looked.where(F.col("code").isNotNull()).select(*names).unionByName(exploded.join(hot, ["pos", "part"], "left_anti").join(cold, ["pos", "part"]).select(*names))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0")), "")
    by_row = back.groupBy("row").agg(digits.alias("code"), F.sum("apart").alias("error"))
    done = written(by_row.join(rows.select("row", "key", "label"), "row"), "codes")
    by_label = written(done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    both = done.join(checked(by_label), F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
