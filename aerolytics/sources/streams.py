"""Streaming sources; each gives a `value` column of lines. The limits of a micro-batch are its rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def directory_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def kafka_lines(spark: SparkSession, brokers: str, topic: str, offsets_per_batch: int | None = None, connector: str = "kafka") -> DataFrame:
    """Needs the Kafka connector on the class path (or another source of its options, by name). Reads from the earliest offset; keys are dropped."""
    reader = spark.readStream.format(connector).option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "earliest")
    if offsets_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_batch)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
