"""Notices: a keyed store with upsert, soft delete and delete, folded from an ordered log of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Notices that are kept, and the delay of their removal in milliseconds.
MOST, REMOVE_AFTER_MS = 1, 1_000_000
ACTION = "stream_id long, seq long, action string, id string, title string"


def newest(added: DataFrame, most: int = MOST) -> DataFrame:
    """The newest ``most`` of each stream's added notices, newest first."""
    by = Window.partitionBy("stream_id").orderBy(F.desc("seq"))
    return added.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def updated(notices: DataFrame, changes: DataFrame, field: str) -> DataFrame:
    """Notices with the last change of each id that gives ``field`` a value; changes of unknown ids change nothing."""
    last = changes.groupBy("stream_id", "id").agg(F.max_by(field, "seq").alias("new"))
    return notices.join(last, ["stream_id", "id"], "left").withColumn(field, F.coalesce("new", field)).drop("new")


def removed(notices: DataFrame, removals: DataFrame) -> DataFrame:
    """Notices without those removed by id; a removal without an id removes all of its stream."""
    every = removals.where(F.col("id").isNull()).select("stream_id").distinct()
    some = removals.where(F.col("id").isNotNull()).select("stream_id", "id").distinct()
    return notices.join(every, "stream_id", "left_anti").join(some, ["stream_id", "id"], "left_anti")


def scheduled_once(dismissals: DataFrame) -> DataFrame:
    """The removal that the first dismissal of each id schedules; later ones schedule nothing."""
    return dismissals.groupBy("stream_id", "id").agg(F.min("seq").alias("seq"))


def folded(log: DataFrame, most: int = MOST) -> DataFrame:
    """(stream_id, id, title, open): the notices that each stream's log of ADD, UPDATE, DISMISS and REMOVE leaves.

    With one notice kept an ADD replaces what there was, so what follows the last ADD decides; with more, a notice
    stays while fewer than ``most`` were added after it. Dismissed notices stay, not open, until they are removed.
    """
    adds = newest(log.where("action = 'ADD'").select("stream_id", "seq", "id", "title"), most).withColumnRenamed("seq", "added")
    later = log.where("action <> 'ADD'").select("stream_id", F.col("seq").alias("at"), "action", F.col("id").alias("for_id"), F.col("title").alias("new_title"))
    hits = adds.join(later, "stream_id", "left")
    applies = (F.col("at") > F.col("added")) & ((F.col("for_id") == F.col("id")) | (F.col("for_id").isNull() & (F.col("action") != "UPDATE")))
    out = hits.groupBy("stream_id", "id", "title", "added").agg(
        F.max_by("new_title", F.when(applies & (F.col("action") == "UPDATE") & F.col("new_title").isNotNull(), F.col("at"))).alias("new_title"),
        F.max(F.coalesce(applies & (F.col("action") == "DISMISS"), F.lit(False))).alias("dismissed"),
        F.max(F.coalesce(applies & (F.col("action") == "REMOVE"), F.lit(False))).alias("gone"),
    )
    return out.where(~F.col("gone")).select("stream_id", "id", F.coalesce("new_title", "title").alias("title"), (~F.col("dismissed")).alias("open"))
