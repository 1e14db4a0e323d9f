"""Topic sources and sinks: Kafka on a cluster, folders of JSON lines otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# The topics and where a first run starts in them.
LISTINGS_TOPIC = "raw.listings_add"
SALES_TOPIC = "raw.sales_add"
STARTING_OFFSETS = "latest"


def read_topic(
    spark: SparkSession, topic: str, servers: str, starting: str = STARTING_OFFSETS, **options: str
) -> DataFrame:
    """Stream of (value, _arrived, _partition, _offset); resumes from the checkpoint if there is one."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
        .load()
        .select(
            F.col("value").cast("string").alias("value"),
            F.col("timestamp").alias("_arrived"),
            F.col("partition").alias("_partition"),
            F.col("offset").alias("_offset"),
        )
    )


def read_topic_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same over a folder of files with one JSON event per line: (value, _arrived)."""
    return (
        spark.readStream.options(**options)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_modification_time").alias("_arrived"),
        )
    )


def as_messages(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in the column ``value``; ``topic`` and ``key`` are kept."""
    kept = [c for c in ("topic", "key") if c in df.columns]
    body = [c for c in df.columns if c not in kept]
    if body == ["value"]:
        return df.select(*kept, "value")
    return df.select(*kept, F.to_json(F.struct(*body)).alias("value"))


def write_topic(df: DataFrame, servers: str, checkpoint: str, topic: str | None = None) -> DataStreamWriter:
    """Kafka writer; rows name their topic unless one is given."""
    writer = (
        as_messages(df)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )
    return writer.option("topic", topic) if topic else writer


def write_topic_files(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same sink as JSON lines, one folder per topic."""
    messages = as_messages(df.drop("key"))
    writer = (
        messages.writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.partitionBy("topic") if "topic" in messages.columns else writer
