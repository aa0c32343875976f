"""Message-bus source and sink. Both need the public Spark Kafka connector on the class path."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from palisade.config import DEFAULT, Settings


def telemetry_messages(
    spark: SparkSession, servers: str, cfg: Settings = DEFAULT, starting: str = "latest",
    group: str | None = None, max_offsets: int | None = None,
) -> DataFrame:
    """Streaming ``value`` text of the telemetry topic; parse it with `parse_messages`."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", cfg.telemetry_topic)
        .option("startingOffsets", starting)
    )
    if group is not None:
        reader = reader.option("kafka.group.id", group)
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().selectExpr("CAST(value AS string) AS value", "timestamp AS received_at")


def alert_writer(messages: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    """``messages``: topic, key, value as made by `alert_messages`."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )


def publish_alerts(messages: DataFrame, servers: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
