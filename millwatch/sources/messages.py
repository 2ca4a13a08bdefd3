"""Raw telemetry messages: landed tables, batch or streaming, and a message queue where its jar exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "topic STRING, payload BINARY, received_at TIMESTAMP, offset BIGINT"


def message_scan(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    """Messages of every topic landed under ``path``. JSON lines carry the payload as base64."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def queue_scan(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """The same columns from a Kafka source (needs the connector jar on the classpath)."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**options).load().select(
        "topic",
        F.col("value").alias("payload"),
        F.col("timestamp").alias("received_at"),
        "offset",
    )


def land_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.select("topic", "payload", "received_at", "offset").write.mode(mode).parquet(path)
