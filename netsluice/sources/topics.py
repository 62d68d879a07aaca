"""Topic source and sink. The connector is chosen by Spark's package settings at submit time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def topic_options(servers: str, topic: str, max_offsets: int | None = None) -> dict[str, str]:
    """Source options: earliest offsets, and at most ``max_offsets`` records per trigger."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def sink_options(servers: str, topic: str) -> dict[str, str]:
    """Sink options: gzip batches, leader acknowledgement."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "1",
        "kafka.compression.type": "gzip",
        "kafka.linger.ms": "50",
        "kafka.batch.size": "262144",
    }


def read_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Records of a topic as text in ``value``; offsets live in the query's checkpoint."""
    return (
        spark.readStream.format("kafka")
        .options(**topic_options(servers, topic, max_offsets))
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def write_topic(values: DataFrame, servers: str, topic: str) -> DataStreamWriter:
    """Writer of a stream of JSON text ``value``; the caller adds checkpoint and trigger."""
    return values.writeStream.format("kafka").options(**sink_options(servers, topic))
