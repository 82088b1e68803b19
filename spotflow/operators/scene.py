"""What a map shows: vehicles on spots and on the move at a time, and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotflow.functions.columns import as_ts, xy_to_lonlat
from spotflow.operators.occupancy import SPOT_KEY, latest_per_key, spot_events

# Fixed value: geographic origin of the site coordinates (lat, lon).
ORIGIN = (37.287280, -121.9850525)


def vehicle_view(df: DataFrame, origin: tuple[float, float] = ORIGIN) -> DataFrame:
    """Flat vehicle rows with position; ``removed`` after an exit or an empty spot."""
    lon, lat = xy_to_lonlat(origin[1], origin[0], "x", "y", metres=True)
    on_spot = F.col("type").isin("parked", "empty")
    return df.select(
        "id", "ts", "site", "level", "object_id", "license",
        F.when(on_spot, F.col("spot")).otherwise(F.lit("")).alias("spot"),
        F.when(on_spot, F.col("type")).otherwise(F.lit("moving")).alias("state"),
        "type",
        F.col("type").isin("exit", "empty").cast("int").alias("removed"),
        "x", "y", lat.alias("lat"), lon.alias("lon"),
    )


def moving_rows(df: DataFrame, after=None, until=None) -> DataFrame:
    """Rows of vehicles on the way, after < ts <= until."""
    rows = df.where(~F.col("type").isin("parked", "empty", "reset"))
    if after is not None:
        rows = rows.where(F.col("ts") > as_ts(after))
    return rows if until is None else rows.where(F.col("ts") <= as_ts(until))


def latest_moving(df: DataFrame) -> DataFrame:
    """Newest row per object; of two at one time the later one."""
    return latest_per_key(df, ["site", "level", "object_id"], ["ts", "id"]).select(*df.columns)


def _earlier(t, seconds: float):
    return F.timestamp_micros(F.unix_micros(as_ts(t)) - int(seconds * 1_000_000))


def retired(df: DataFrame, a, b, idle_s: float = 5.0) -> DataFrame:
    """Vehicles that fell idle between the ticks a and b: their last row, ``removed`` set.

    A vehicle is idle ``idle_s`` after its last moving or entry row, unless it
    has left through an exit since. Only rows younger than ``idle_s`` at a can
    decide that, so older ones are not read.
    """
    rows = df.where(
        F.col("type").isin("moving", "entry", "exit") & (F.col("ts") <= as_ts(b)) & (F.col("ts") > _earlier(a, idle_s))
    )
    last = latest_moving(rows).where(F.col("type") != "exit")
    idle = F.unix_micros("ts") + int(idle_s * 1_000_000)
    return last.where(
        (idle > F.unix_micros(as_ts(a))) & (idle <= F.unix_micros(as_ts(b)))
    )


def scene_at(df: DataFrame, t, back_s: float = 0.5, since=None) -> DataFrame:
    """First picture: the last event of each spot, and what moved in the last moment."""
    rows = spot_events(df).where(F.col("ts") <= as_ts(t))
    if since is not None:
        rows = rows.where(F.col("ts") >= as_ts(since))
    on_spots = latest_per_key(rows, SPOT_KEY, ["ts", "id"]).select(*df.columns)
    return vehicle_view(on_spots.unionByName(latest_moving(moving_rows(df, _earlier(t, back_s), t))))


def scene_delta(df: DataFrame, a, b, idle_s: float = 5.0) -> DataFrame:
    """Changes after tick a up to tick b: spot events, movements, retired vehicles."""
    on_spots = spot_events(df).where((F.col("ts") > as_ts(a)) & (F.col("ts") <= as_ts(b)))
    gone = retired(df, a, b, idle_s)
    moved = latest_moving(moving_rows(df, a, b)).join(
        gone.select("site", "level", "object_id"), ["site", "level", "object_id"], "left_anti"
    ).select(*df.columns)
    shown = vehicle_view(on_spots.unionByName(moved))
    return shown.unionByName(vehicle_view(gone).withColumn("removed", F.lit(1)))


def visible(df: DataFrame, t, idle_s: float = 5.0) -> DataFrame:
    """All a viewer shows at t after every change: parked and not yet retired vehicles."""
    rows = df.where(F.col("ts") <= as_ts(t))
    parked = latest_per_key(spot_events(rows), SPOT_KEY, ["ts", "id"]).where(
        F.col("type") == "parked"
    )
    # older rows are retired by now, so they cannot show a vehicle
    moving = latest_moving(moving_rows(rows, _earlier(t, idle_s))).where(F.col("type") != "exit")
    return vehicle_view(parked.select(*df.columns).unionByName(moving))
