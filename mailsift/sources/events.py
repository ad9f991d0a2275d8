"""Keyed JSON event streams: a broker topic, or a folder of JSON lines as its connector-free twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"


def kafka_lines(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """Streaming (key, value) text rows of a topic; needs the Kafka connector on the classpath."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", starting).load()
        .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    )


def file_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same shape from text files of one JSON record per line."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(F.lit(None).cast("string").alias("key"), "value")


def decode(lines: DataFrame, schema: StructType) -> DataFrame:
    """Parsed records; a line that is no record keeps its text in the corrupt column."""
    wide = StructType([*schema.fields]).add(CORRUPT, "string")
    return lines.select(
        F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")
    ).select("r.*")


def good_records(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def poison_records(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def encode(events: DataFrame) -> DataFrame:
    """(key, value) rows of (key, event) rows, ready for a topic."""
    return events.select(F.col("key").cast("string").alias("key"), F.to_json("event").alias("value"))


def to_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Start publishing a stream; the sender key picks the partition, so one sender stays in one."""
    return (
        encode(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint).start()
    )
