"""File sources and sinks: canonical parquet, message text, and graph snapshots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import schemas
from palisade.functions import scalar as X


def _reader(spark: SparkSession, files_per_trigger: int | None):
    reader = spark.readStream
    return reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)


def telemetry_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Canonical telemetry files as a stream."""
    return _reader(spark, files_per_trigger).schema(schemas.TELEMETRY).parquet(path)


def message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """One JSON message per line; same ``value`` column as the message bus."""
    return _reader(spark, files_per_trigger).text(path)


def write_snapshot(edges: DataFrame, path: str, as_of: Column) -> None:
    """Freeze the edge table as of one moment; readers of older snapshots are not disturbed."""
    stamped = edges.withColumn("as_of_us", X.micros(as_of))
    stamped.write.mode("append").partitionBy("as_of_us").parquet(path)


def read_snapshot(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    return spark.read.parquet(path).where(F.col("as_of_us") == X.micros(as_of))


def write_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").partitionBy("topic").parquet(path)
