"""What several operators share: written intermediate tables, bounded Arrow batches, salted joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribewell.sources.scratch import shared_folder, small_batches

#: A key is hot from this share of all rows on, so that there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 400
#: Ways that a hot key is dealt out.
SALTS = 64


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``make`` runs once in each task and holds its state.

    A worker gives the memory of its batches back after each task, as it stays for tasks of other stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of a few dozen bytes that may be broadcast; with more, a join shuffles.
BROADCAST_ROWS = 200_000


def checked(df: DataFrame) -> DataFrame:
    """``df``, a written table of short rows, to be broadcast if it has no more than BROADCAST_ROWS rows, else to be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Keys with at least HOT_SHARE of ``total`` rows: no more than 1 / HOT_SHARE of them, so they can be broadcast."""
    return counts.where(F.col(n) >= max(2, int(total * HOT_SHARE))).select(key).withColumn("_hot", F.lit(True))


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, spread_by: str) -> DataFrame:
    """Left join of ``many`` rows for a key with the ``one`` row that ``one`` has for it.

    Rows of hot keys are dealt out SALTS ways by a hash of ``spread_by``, and the few matching rows
    of ``one`` are repeated for them, so that no task gets a hot key whole. Null keys find nothing.
    """
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = many.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
