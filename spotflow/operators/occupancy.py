"""Spot state: as-of lookups, history tables and occupancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotflow.functions.columns import as_ts
from spotflow.operators.flow import hourly, latest_flow

SPOT_KEY = ["site", "level", "spot"]
SPOT_TYPES = ("parked", "empty")


def spot_events(df: DataFrame) -> DataFrame:
    """Parked and empty rows that name a spot."""
    return df.where(F.col("type").isin(*SPOT_TYPES) & F.col("spot").isNotNull())


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key. An aggregate, so partial results combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *keys, "_r.*"
    )


def spot_state(df: DataFrame) -> DataFrame:
    """Newest parked/empty row of each spot."""
    return latest_per_key(spot_events(df), SPOT_KEY, ["ts", "id"])


def spot_history(df: DataFrame) -> DataFrame:
    """Parked/empty rows, one per (spot, sensor, time); the last written wins."""
    return latest_per_key(spot_events(df), [*SPOT_KEY, "sensor", "ts"], ["id"])


def aisle_rows(df: DataFrame) -> DataFrame:
    """Rows that are no spot changes, under the key site-level."""
    return df.where(~F.col("type").isin(*SPOT_TYPES)).withColumn(
        "messageid", F.concat_ws("-", "site", "level")
    )


def capacity(spots: DataFrame, *by: str) -> DataFrame:
    """Number of distinct spots."""
    return spots.groupBy(*by).agg(F.countDistinct(*SPOT_KEY).alias("total"))


def spots_as_of(spots: DataFrame, history: DataFrame, at, since=None) -> DataFrame:
    """Each spot with its last event at or before ``at`` (and not before ``since``)."""
    rows = spot_events(history).where(F.col("ts") <= as_ts(at))
    if since is not None:
        rows = rows.where(F.col("ts") >= as_ts(since))
    last = latest_per_key(rows, SPOT_KEY, ["ts", "id"])
    return spots.select(*SPOT_KEY).distinct().join(last, SPOT_KEY, "left")


def occupancy(spots: DataFrame, history: DataFrame, at, since=None,
              by: tuple[str, ...] = ("site",)) -> DataFrame:
    """Total, occupied and available spots at a time."""
    counted = (
        spots_as_of(spots, history, at, since)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("type") == "parked").alias("occupied"),
        )
    )
    return counted.select(
        *by,
        "total",
        F.least("occupied", "total").alias("occupied"),
        F.greatest(F.col("total") - F.col("occupied"), F.lit(0)).alias("available"),
    )


def site_stats(spots: DataFrame, history: DataFrame, flow: DataFrame, at, since=None) -> DataFrame:
    """One row per site: free and occupied spots, newest entry and exit rate."""
    rates = latest_flow(flow, before=at, since=since)
    zero = hourly(F.lit(None).cast("int"))
    return (
        occupancy(spots, history, at, since)
        .withColumnRenamed("site", "id")
        .join(rates, "id", "left")
        .select(
            "id",
            F.col("available").alias("free_spots"),
            F.col("occupied").alias("occupied_spots"),
            F.coalesce("entry", zero).alias("entry_flow"),
            F.coalesce("exit", zero).alias("exit_flow"),
        )
    )
