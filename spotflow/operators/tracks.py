"""Vehicle tracks: sessions, smoothing, distance, speed and heading."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from spotflow.functions.columns import angle_rad, euclid
from spotflow.operators.ordered import SLICE, chunked, marked, null_safe, numbered

CHUNK = 10_000


def bounding_box(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    ).select(
        "*",
        (F.col("x_max") - F.col("x_min")).alias("x_extent"),
        (F.col("y_max") - F.col("y_min")).alias("y_extent"),
    )


def track_sessions(df: DataFrame, keys: list[str], gap_s: float = 6.0,
                   width: float = SLICE) -> DataFrame:
    """Add ``track_start``: rows of a key belong together until a gap of ``gap_s``."""
    gap = int(gap_s * 1_000_000)

    def opens(get, before):
        late = F.unix_micros(get("ts")) - F.unix_micros(before) >= gap
        return F.when(before.isNull() | late, get("ts"))

    rows = marked(df, keys, ["ts", "id"], F.col("ts"), opens, ["ts"], width)
    return rows.select(*df.columns, F.col("last_mark").alias("track_start"))


def valid_tracks(df: DataFrame, keys: list[str] = ["sensor", "object_id"], gap_s: float = 6.0,
                 min_s: float = 3.0, width: float = SLICE) -> DataFrame:
    """Rows of the tracks that last longer than ``min_s``; shorter ones are noise."""
    rows = track_sessions(df, keys, gap_s, width)
    lasting = (
        rows.groupBy(*keys, "track_start")
        .agg(F.max("ts").alias("_end"))
        .where(F.unix_micros("_end") - F.unix_micros("track_start") > int(min_s * 1_000_000))
    )
    return rows.join(*null_safe(rows, lasting, [*keys, "track_start"]), "left_semi")


def smooth_track(df: DataFrame, keys: list[str], order: list[str] = ["ts", "id"],
                 threshold: int = 100, width: float = SLICE) -> DataFrame:
    """Points of each track in order (``seq`` from 0).

    A track of ``threshold`` points or more becomes its first point, the means
    of every 5 consecutive points, and its last point.
    """
    points = numbered(df.select(*keys, *order, "x", "y"), keys, order, "_n", "_total", width)
    spread = chunked(points, "_n", CHUNK, 4)
    five = W.partitionBy(*keys, "_chunk").orderBy("_n").rowsBetween(0, 4)
    mean = spread.select(
        *keys, "_n", "_total", "_home", "x", "y",
        F.avg("x").over(five).alias("mx"), F.avg("y").over(five).alias("my"),
    ).where("_home")
    long_track = F.col("_total") >= threshold

    def point(seq, x, y):
        return F.struct(seq.cast("long").alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))

    n, total = F.col("_n"), F.col("_total")
    emitted = F.when(
        long_track,
        F.array_compact(
            F.array(
                F.when(n == 1, point(F.lit(0), "x", "y")),
                F.when(n <= total - 4, point(n, "mx", "my")),
                F.when(n == total, point(total - 3, "x", "y")),
            )
        ),
    ).otherwise(F.array(point(n - 1, "x", "y")))
    return mean.select(*keys, F.explode(emitted).alias("p")).select(*keys, "p.*")


def track_distance(points: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the way along the points, and from the first to the last one."""
    spread = chunked(points, "seq", CHUNK, 1)
    w = W.partitionBy(*keys, "_chunk").orderBy("seq")
    step = euclid("x", "y", F.lead("x").over(w), F.lead("y").over(w))
    steps = spread.select(*keys, "seq", "x", "y", "_home", step.alias("d")).where("_home")
    ends = F.struct("x", "y")
    return (
        steps.groupBy(*keys)
        .agg(
            F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance"),
            F.min_by(ends, "seq").alias("a"),
            F.max_by(ends, "seq").alias("b"),
        )
        .select(
            *keys, "distance",
            euclid("a.x", "a.y", "b.x", "b.y").alias("linear_distance"),
        )
    )


def track_duration(df: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds from the first to the last row, to the millisecond."""
    ms = F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))
    return df.groupBy(*keys).agg((ms / 1000.0).alias("duration"))


def track_speed(distance, duration):
    """km/h over whole seconds; 0 for a track shorter than one."""
    whole = F.floor(duration)
    return F.when(whole == 0, F.lit(0.0)).otherwise(distance * 3.6 / whole)


def track_summary(df: DataFrame, keys: list[str], threshold: int = 100,
                  width: float = SLICE) -> DataFrame:
    """Distance, straight distance, duration and speed of each track."""
    along = track_distance(smooth_track(df, keys, threshold=threshold, width=width), keys)
    lasted = track_duration(df, keys)
    other, same = null_safe(along, lasted, keys)
    return along.join(other, same).select(*along.columns, "duration").withColumn(
        "speed", track_speed(F.col("distance"), F.col("duration"))
    )


def heading(df: DataFrame, keys: list[str], order: list[str] = ["ts", "id"],
            width: float = SLICE, known: str | None = None) -> DataFrame:
    """Degrees [0, 360) from the previous position; kept while the vehicle stands.

    ``known``: a column with headings that are given, where not null.
    """
    def turn(get, before):
        moved = (before.x != get("x")) | (before.y != get("y"))
        angle = F.when(moved, angle_rad(before.x, before.y, get("x"), get("y")) * 180.0 / math.pi)
        return F.coalesce(get(known), angle) if known else angle

    needs = ["x", "y", known] if known else ["x", "y"]
    rows = marked(df, keys, order, F.struct("x", "y"), turn, needs, width)
    return rows.select(*df.columns, F.col("last_mark").alias("heading"))
