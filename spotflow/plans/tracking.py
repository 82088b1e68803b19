"""The tracker as one batch job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spotflow.operators import known_ids, tracking as tr
from spotflow.operators.ordered import SLICE
from spotflow.operators.projections import qualify_object_id
from spotflow.operators.quality import classify_records, drop_reset
from spotflow.operators.regions import ignore_flags, snap_to_roads


@dataclass(frozen=True)
class TrackerConfig:
    frame_s: float = 0.5
    cluster_d: float = 15.0
    match_d: float = 20.0
    carry_s: float = 3.0
    snap: bool = False
    snap_d: float = 20.0
    slice_s: float = SLICE
    known_s: float = 20.0


@dataclass(frozen=True)
class Tracked:
    """Tables of a tracker run."""

    rows: DataFrame
    pairs: DataFrame
    clustered: DataFrame
    sets: DataFrame


def prepare(df: DataFrame, regions: DataFrame | None = None, lines: DataFrame | None = None,
            cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Usable detections with frame and ``record_class``; ids made unique, levels upper-case."""
    rows = drop_reset(df).where(F.col("ts").isNotNull())
    rows = qualify_object_id(rows).withColumn("level", F.upper("level")).withColumn(
        "license", F.coalesce("license", F.lit(""))
    )
    if regions is not None:
        rows = ignore_flags(rows, regions).where(~F.col("ignored")).drop("ignored")
    rows = classify_records(rows)
    if cfg.snap and lines is not None:
        moving = F.col("type") == "moving"
        snapped = snap_to_roads(rows.where(moving), lines, cfg.snap_d).select(*rows.columns)
        rows = snapped.unionByName(rows.where(~moving | F.col("type").isNull()))
    return tr.frames(rows, cfg.frame_s)


def spot_pass_through(prepared: DataFrame) -> DataFrame:
    """Rows the matching leaves alone: spot changes and rows of no known kind."""
    return prepared.where(F.col("record_class").isin("emptySpots", "others", "parked"))


def track_batch(df: DataFrame, regions: DataFrame | None = None, lines: DataFrame | None = None,
                conflicts: DataFrame | None = None, overlaps: DataFrame | None = None,
                cfg: TrackerConfig = TrackerConfig()) -> Tracked:
    """Detections → the same vehicles under one id and plate across cameras and frames."""
    ready = prepare(df, regions, lines, cfg)
    moving = tr.collapse_frame(ready.where(F.col("record_class") == "moving"))
    clustered, sets = known_ids.cluster_known(
        tr.cut(moving), cfg.cluster_d, conflicts, overlaps, keep_s=cfg.known_s, frame_s=cfg.frame_s
    )
    clustered = tr.cut(clustered)
    merged = tr.cut(tr.cluster_output(clustered).drop("cluster"))
    pairs = tr.match_frames(merged, cfg.match_d, cfg.carry_s, cfg.frame_s, conflicts, cfg.slice_s)
    labelled = tr.label_tracks(merged, pairs, cfg.slice_s)
    passed = spot_pass_through(ready)
    rows = labelled.unionByName(passed, allowMissingColumns=True)
    return Tracked(rows, pairs, clustered, sets)
