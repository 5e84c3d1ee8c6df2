"""Frames as space-joined messages in a `value` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def top_messages(lists: DataFrame, key: str, best: str = "best") -> DataFrame:
    """One `key name value` message for each element of an array of (name, value)."""
    return lists.select(key, F.explode(best).alias("b")).select(F.concat_ws(" ", key, F.col("b")[lists.schema[best].dataType.elementType.names[0]], F.col("b")[lists.schema[best].dataType.elementType.names[1]].cast("string")).alias("value"))


def route_messages(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))


def to_kafka(messages: DataFrame, brokers: str, topic: str, connector: str = "kafka") -> None:
    """Needs the Kafka connector on the class path (or another source of its options, by name)."""
    messages.select("value").write.format(connector).option("kafka.bootstrap.servers", brokers).option("topic", topic).mode("append").save()


def stream_to_kafka(messages: DataFrame, brokers: str, topic: str, checkpoint: str, once: bool = False, connector: str = "kafka") -> StreamingQuery:
    """Sends a stream of messages; once: until the input that is there is used up."""
    writer = messages.select("value").writeStream.format(connector).option("kafka.bootstrap.servers", brokers).option("topic", topic).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
