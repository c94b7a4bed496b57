"""Transcripts: what a model's answer emits, and ordered folds of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def emitted(outputs: Column) -> Column:
    """A model's outputs by lines, nulls as empty lines; null outputs emit nothing, no outputs an empty text."""
    return F.array_join(F.transform(outputs, lambda x: F.coalesce(x, F.lit(""))), "\n")


def appended(pieces: DataFrame) -> DataFrame:
    """Each stream's pieces in order with a line break before every one; null pieces are empty."""
    text = F.expr("concat('\n', listagg(coalesce(piece, ''), '\n') WITHIN GROUP (ORDER BY seq))")
    return pieces.groupBy("stream_id").agg(text.alias("transcript"))


def joined(pieces: DataFrame) -> DataFrame:
    """Each stream's pieces in order with line breaks between, once there is any text: leading empty pieces vanish."""
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.max(F.coalesce(F.col("piece"), F.lit("")) != "").over(before)
    text = F.expr("coalesce(listagg(CASE WHEN begun THEN coalesce(piece, '') END, '\n') WITHIN GROUP (ORDER BY seq), '')")
    return pieces.withColumn("begun", begun).groupBy("stream_id").agg(text.alias("transcript"))
