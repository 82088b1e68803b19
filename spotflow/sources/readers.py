"""Sources: event topics and files, dimensions and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotflow.operators.projections import parse_events
from spotflow.operators.quality import in_time_range
from spotflow.schema import EVENT_SCHEMA

KAFKA = {"failOnDataLoss": "false"}


def _messages(df: DataFrame) -> DataFrame:
    """(key, value) as text, with the topic's own time where there is one."""
    extra = ["timestamp"] if "timestamp" in df.columns else []
    return df.select(F.col("key").cast("string"), F.col("value").cast("string"), *extra)


def read_events_stream(spark: SparkSession, fmt: str, options: dict | None = None,
                       schema: str | None = None) -> DataFrame:
    """Messages of a stream. ``fmt`` 'kafka' starts at the latest offset and tolerates loss;
    file formats need ``path`` among the options and (key, value) files."""
    defaults = {**KAFKA, "startingOffsets": "latest"} if fmt == "kafka" else {}
    reader = spark.readStream.format(fmt).options(**defaults, **(options or {}))
    if fmt != "kafka":
        reader = reader.schema(schema or "key string, value string")
    return _messages(reader.load())


def read_events(spark: SparkSession, fmt: str, options: dict | None = None,
                schema: str | None = None) -> DataFrame:
    """The same in batch, from the earliest offset."""
    defaults = {**KAFKA, "startingOffsets": "earliest"} if fmt == "kafka" else {}
    reader = spark.read.format(fmt).options(**defaults, **(options or {}))
    if fmt != "kafka":
        reader = reader.schema(schema or "key string, value string")
    return _messages(reader.load())


def rate_limited_source(spark: SparkSession, fmt: str, options: dict | None = None,
                        max_records: int = 5000, max_files: int = 1,
                        schema: str | None = None) -> DataFrame:
    """A stream that hands out a bounded amount per trigger (records, or files).

    Start the query with ``trigger(processingTime='0.5 seconds')`` to poll twice a second.
    """
    limit = (
        {"maxOffsetsPerTrigger": str(max_records)}
        if fmt == "kafka"
        else {"maxFilesPerTrigger": str(max_files)}
    )
    return read_events_stream(spark, fmt, {**limit, **(options or {})}, schema)


def detection_lines(lines: DataFrame, start=None, end=None) -> DataFrame:
    """JSON lines (column ``value``) → nested events with start <= time < end, no resets."""
    events = parse_events(lines).where(F.col("event.type") != "reset")
    return in_time_range(events, start, end, "`@timestamp`")


def read_detection_lines(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    return detection_lines(spark.read.text(path), start, end)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Nested events stored as parquet; unread members are pruned from the scan."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """Spot ids of a CSV file with a header, once each."""
    return spark.read.csv(path, header=True).distinct()


def read_plate_list(spark: SparkSession, path: str) -> DataFrame:
    """One plate per line."""
    lines = spark.read.text(path).select(F.trim("value").alias("license"))
    return lines.where("license <> ''").distinct()
