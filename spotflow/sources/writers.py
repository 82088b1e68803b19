"""Sinks. Tables are parquet folders; every batch owns its partition, so a batch
that runs twice after a failure overwrites itself and nothing is written twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from spotflow.operators import occupancy, search
from spotflow.operators.flow import flow_table
from spotflow.operators.projections import encrypt_plate, to_wire_json, topic_partition
from spotflow.operators.tracking import cluster_audit, input_audit, match_audit


def messages(df: DataFrame, key: Column) -> DataFrame:
    """(key, value) rows for a topic; value is the row as JSON."""
    return df.select(key.cast("string").alias("key"), to_wire_json(df).alias("value"))


def write_table(df: DataFrame, path: str, batch: int = 0, by: tuple[str, ...] = ()) -> None:
    """Write one batch of a table, replacing what an earlier run of the batch left."""
    parts = [*by, "batch"]
    (
        df.withColumn("batch", F.lit(batch).cast("long"))
        .write.partitionBy(*parts)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_messages(df: DataFrame, fmt: str = "parquet", options: dict | None = None,
                   batch: int = 0) -> None:
    """(key, value) rows to a topic ('kafka') or a table."""
    options = dict(options or {})
    if fmt == "parquet":
        write_table(df, options.pop("path"), batch)
    else:
        df.write.format(fmt).options(**options).mode("append").save()


def write_anomalies(anomalies: DataFrame, fmt: str = "parquet", options: dict | None = None,
                    batch: int = 0, key: str | None = None, iv: str | None = None) -> None:
    """Anomaly rows as (type, JSON); plates encrypted where a key is given."""
    if key:
        plate = encrypt_plate("object.vehicle.license", key, iv)
        anomalies = anomalies.withColumn("object", F.col("object").withField("vehicle.license", plate))
    write_messages(messages(anomalies, F.col("event.type")), fmt, options, batch)


def pass_through(events: DataFrame, key: str | None = None, iv: str | None = None,
                 partitions: int = 8) -> DataFrame:
    """Events as messages for the next topic: plates encrypted, except on resets.

    ``partition`` spreads the messages over the topic's partitions.
    """
    if key:
        plate = F.when(
            F.col("event.type") == "reset", F.col("object.vehicle.license")
        ).otherwise(encrypt_plate("object.vehicle.license", key, iv))
        events = events.withColumn(
            "object",
            F.when(F.col("object.vehicle").isNull(), F.col("object")).otherwise(
                F.col("object").withField("vehicle.license", plate)
            ),
        )
    wire = events.drop("timestamp") if "@timestamp" in events.columns else events
    return messages(wire, F.col("messageid")).withColumn(
        "partition", topic_partition("key", "value", partitions=partitions)
    )


def write_pass_through(events: DataFrame, fmt: str = "parquet", options: dict | None = None,
                       batch: int = 0, key: str | None = None, iv: str | None = None) -> None:
    write_messages(pass_through(events, key, iv), fmt, options, batch)


def write_tracked(events: DataFrame, fmt: str = "parquet", options: dict | None = None,
                  batch: int = 0) -> None:
    """Tracked detections as messages for the next topic, keyed by sensor."""
    write_messages(messages(events, F.col("sensor")), fmt, options, batch)


# -- state and history tables --------------------------------------------------------------


def upsert_spot_state(df: DataFrame, path: str, batch: int = 0) -> None:
    """Add the newest row per spot of this batch; the reader takes the newest batch per spot.

    No batch rewrites the state of spots it does not touch.
    """
    write_table(occupancy.spot_state(df), path, batch)


# What makes two rows of a table one row, whatever batch they came in.
TABLE_KEYS = {
    "spot_state": occupancy.SPOT_KEY,
    "spot_history": [*occupancy.SPOT_KEY, "sensor", "ts"],
    "aisle": ["messageid", "ts", "object_id"],
    "anomalies": ["fingerprint"],
}


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a table, one per key: that of the last batch which had it."""
    rows = spark.read.parquet(path)
    order = ["batch", *[c for c in ("ts", "id") if c in rows.columns and c not in TABLE_KEYS[kind]]]
    return occupancy.latest_per_key(rows, TABLE_KEYS[kind], order)


def compact(spark: SparkSession, path: str, target: str, kind: str, by: tuple[str, ...] = (), batch: int = 0) -> None:
    """Write what a table says now as the only batch of a new table."""
    write_table(read_table(spark, path, kind).drop("batch"), target, batch, by)


def read_spot_state(spark: SparkSession, path: str) -> DataFrame:
    """Current row per spot: that of the last batch which had one."""
    return read_table(spark, path, "spot_state")


def compact_spot_state(spark: SparkSession, path: str, target: str, batch: int = 0) -> None:
    compact(spark, path, target, "spot_state", batch=batch)


def without_spot(df: DataFrame) -> DataFrame:
    """Parked and empty rows that name no spot; the history tables cannot hold them."""
    return df.where(F.col("type").isin(*occupancy.SPOT_TYPES) & F.col("spot").isNull())


def append_spot_history(df: DataFrame, path: str, batch: int = 0, rejected: str | None = None) -> None:
    """Spot changes by site, level and day; rows without a spot go to ``rejected``."""
    rows = occupancy.spot_history(df).withColumn("day", F.to_date("ts"))
    write_table(rows, path, batch, ("site", "level", "day"))
    if rejected:
        write_table(without_spot(df), rejected, batch)


def append_aisle(df: DataFrame, path: str, batch: int = 0) -> None:
    """Rows of vehicles on the way, one per (site-level, time, object)."""
    rows = occupancy.latest_per_key(occupancy.aisle_rows(df), ["messageid", "ts", "object_id"], ["id"])
    write_table(rows.withColumn("day", F.to_date("ts")), path, batch, ("messageid", "day"))


def upsert_flow_rate(flow: DataFrame, path: str, batch: int = 0) -> None:
    """Rates as one row per site and window end."""
    write_table(flow_table(flow), path, batch)


def read_flow_rate(spark: SparkSession, path: str) -> DataFrame:
    """Entry and exit of a window may arrive in different batches: take the last of each."""
    rows = spark.read.parquet(path)
    last = [
        F.max_by(k, F.when(F.col(k).isNotNull(), F.col("batch"))).alias(k) for k in ("entry", "exit")
    ]
    return rows.groupBy("id", "timestamp").agg(*last)


def write_monthly_index(df: DataFrame, path: str, kind: str, batch: int = 0, distinct: bool = False) -> None:
    """Rows by type, year and month; anomalies (``distinct``) once per fingerprint."""
    rows = search.distinct_anomalies(df) if distinct else df
    write_table(search.monthly(rows, kind), path, batch, ("index_type", "year", "month"))


def write_audit(path: str, kept: DataFrame, ignored: DataFrame, clustered: DataFrame,
                pairs: DataFrame, tracked: DataFrame, frame_s: float = 0.5, batch: int = 0) -> None:
    """The tracker's three audit tables: input points, cluster points, match points."""
    write_table(input_audit(kept, ignored, frame_s), f"{path}/points", batch)
    write_table(cluster_audit(clustered), f"{path}/clusters", batch)
    write_table(match_audit(pairs, tracked), f"{path}/matches", batch)


def report_invalid(invalid: DataFrame, checkpoint: str, fmt: str = "console",
                   options: dict | None = None, every: str = "60 seconds") -> DataStreamWriter:
    """Writer of a stream's invalid rows, once a minute."""
    extra = {"truncate": "false"} if fmt == "console" else {}
    return (
        invalid.writeStream.format(fmt).outputMode("append")
        .options(**{**extra, **(options or {}), "checkpointLocation": checkpoint})
        .trigger(processingTime=every)
    )
