"""Kafka source and sink.

The Kafka connector is not bundled with PySpark; the user adds it with
``--packages org.apache.spark:spark-sql-kafka-0-10_<scala>:<version>``. These functions only
build the reader / writer, so they can be unit-tested without a broker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import cast_event_times, parse_json_records

TOPIC = "news_exposure_logs"


def stream_options(servers: str, topic: str = TOPIC) -> dict[str, str]:
    """S4 options: subscribe from the latest offsets, tolerate deleted segments."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
    }


def batch_options(servers: str, topic: str = TOPIC) -> dict[str, str]:
    """S5 options: bounded read of the whole topic (earliest → latest)."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "endingOffsets": "latest",
    }


def stream_exposures_kafka(spark: SparkSession, servers: str, topic: str = TOPIC) -> DataFrame:
    """S4 + T1 + T2: parsed exposure stream from Kafka."""
    raw = spark.readStream.format("kafka").options(**stream_options(servers, topic)).load()
    return cast_event_times(parse_json_records(raw))


def read_exposures_kafka(spark: SparkSession, servers: str, topic: str = TOPIC) -> DataFrame:
    """S5 + T1 + T2: the topic's current content as a batch DataFrame."""
    raw = spark.read.format("kafka").options(**batch_options(servers, topic)).load()
    return cast_event_times(parse_json_records(raw))


def kafka_value(df: DataFrame) -> DataFrame:
    """K5 payload: every row as one JSON ``value`` (keyed by impression when present)."""
    cols = [F.to_json(F.struct(*df.columns)).alias("value")]
    if "impression_id" in df.columns:
        cols.append(F.col("impression_id").alias("key"))
    return df.select(*cols)


def sink_kafka(df: DataFrame, servers: str, topic: str = TOPIC, *, checkpoint: str):
    """K5: publish a stream to Kafka as JSON (producer ``acks=1``)."""
    return (
        kafka_value(df)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.acks", "1")
        .option("checkpointLocation", checkpoint)
        .start()
    )
