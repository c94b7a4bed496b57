"""Tables as the engine reads them: pages, messages, sample chunks, transcript pieces, and fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How event types of the events table stand for messages.
MESSAGE_OF_EVENT = {"signup": "start-transcription", "purchase": "recording-state", "view": "transcript", "click": "stop-transcription", "error": "model-status"}
#: Payload of a message, as far as its fields are known; events carry a JSON object in props.
MESSAGE = "seq long, ts timestamp, stream_id string, type string, payload string"
CHUNK = "stream_id int, seq long, samples array<float>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(events: DataFrame) -> DataFrame:
    """Events as messages: order by (ts, seq), stream by user; the type after MESSAGE_OF_EVENT, else the event's own."""
    kind = F.col("event_type")
    for event, message in MESSAGE_OF_EVENT.items():
        kind = F.when(F.col("event_type") == event, message).otherwise(kind)
    return events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("stream_id"), kind.alias("type"), F.col("props").alias("payload"))


def chunks(embeddings: DataFrame) -> DataFrame:
    """Vectors as sample chunks: the label is the stream and vec_id the order in it."""
    return embeddings.select(F.col("label").alias("stream_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))


def pages(raw: DataFrame) -> DataFrame:
    """Pages that have content."""
    return raw.where(F.col("html").isNotNull() & (F.col("html") != ""))


def first_page(raw: DataFrame) -> DataFrame:
    """The page that is looked at: the first by id."""
    return pages(raw).orderBy("page_id").limit(1)


def pieces(conversations: DataFrame) -> DataFrame:
    """Conversation turns as transcript pieces."""
    return conversations.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("piece"))
