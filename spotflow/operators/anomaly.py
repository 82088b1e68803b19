"""Overstay, understay, stopping and list anomalies."""

from __future__ import annotations

from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from spotflow.functions.columns import hours_between
from spotflow.operators.lineage import cut, python_groups
from spotflow.operators.occupancy import SPOT_KEY, spot_events
from spotflow.operators.ordered import SLICE, after, before, marked
from spotflow.operators.projections import with_vehicle_key
from spotflow.operators.quality import identified_only

ORDER = ["ts", "id"]


def spot_intervals(df: DataFrame, width: float = SLICE) -> DataFrame:
    """Every parked row with the next event of its spot (null if there is none)."""
    nxt = F.struct("ts", "type", "video")
    return (
        after(spot_events(df), SPOT_KEY, ORDER, {"next": nxt}, width)
        .where(F.col("type") == "parked")
        .select(
            "id", *SPOT_KEY, "license", "object_id",
            F.col("ts").alias("start_ts"),
            F.col("next.ts").alias("end_ts"),
            F.col("next.type").alias("next_type"),
            F.col("video").alias("entry_video"),
            F.col("next.video").alias("exit_video"),
        )
    )


def overstay(df: DataFrame, threshold_h: float = 5 / 60, include_open: bool = False, now=None,
             width: float = SLICE) -> DataFrame:
    """Stays that ended with ``empty`` and took longer than the threshold (hours).

    ``include_open`` adds vehicles still there, measured up to ``now``.
    """
    stays = spot_intervals(df, width)
    ended = F.col("next_type") == "empty"
    if include_open:
        ended = ended | F.col("next_type").isNull()
    hours = hours_between("start_ts", "end_ts", now if include_open else None)
    return stays.where(ended).withColumn("hours", hours).where(F.col("hours") > threshold_h)


def understay(df: DataFrame, interval_s: float = 300, width: float = SLICE) -> DataFrame:
    """Vehicles that left within ``interval_s`` of their last entry.

    The exit must be later than the entry; of several exits after one entry
    the first counts.
    """
    rows = with_vehicle_key(identified_only(df)).where(F.col("type").isin("entry", "exit"))
    entry = F.when(
        F.col("type") == "entry", F.struct("id", "ts", "site", "level", "spot", "object_id", "license", "video")
    )
    exits = before(rows, ["plate"], ORDER, {"entered": entry}, width).where(
        (F.col("type") == "exit")
        & (F.col("ts") > F.col("entered.ts"))
        & (F.unix_micros("ts") - F.unix_micros("entered.ts") < int(interval_s * 1_000_000))
    )
    first = exits.groupBy("plate", F.col("entered.id").alias("entry_id")).agg(
        F.min_by(F.struct("entered", "id", "ts", "video"), F.struct(*ORDER)).alias("r")
    )
    return first.select(
        "plate", "entry_id",
        *[F.col(f"r.entered.{c}").alias(c) for c in ("site", "level", "spot", "object_id", "license")],
        F.col("r.entered.ts").alias("start_ts"),
        F.col("r.entered.video").alias("entry_video"),
        F.col("r.id").alias("exit_id"),
        F.col("r.ts").alias("end_ts"),
        F.col("r.video").alias("exit_video"),
    )


def plate_lists(white: DataFrame, black: DataFrame) -> DataFrame:
    """(license, list); a plate on both lists counts as whitelisted."""
    both = white.select("license", F.lit(0).alias("p")).unionByName(
        black.select("license", F.lit(1).alias("p"))
    )
    return both.groupBy("license").agg(F.min("p").alias("p")).select(
        "license", F.when(F.col("p") == 0, "Whitelist").otherwise("Blacklist").alias("list")
    )


def list_anomaly(df: DataFrame, white: DataFrame, black: DataFrame) -> DataFrame:
    """Entries and exits of listed plates (exact text). AQE broadcasts the lists if small."""
    return df.where(F.col("type").isin("entry", "exit")).join(plate_lists(white, black), "license")


def unlisted(df: DataFrame, white: DataFrame, black: DataFrame) -> DataFrame:
    return df.where(F.col("type").isin("entry", "exit")).join(
        plate_lists(white, black), "license", "left_anti"
    )


# -- stopped where it should not ----------------------------------------------------


def on_the_way(df: DataFrame) -> DataFrame:
    """Rows of identified vehicles that are on no spot."""
    rows = df.where(~F.col("type").isin("parked", "empty", "reset"))
    return with_vehicle_key(identified_only(rows))


def motion_windows(df: DataFrame, window_s: int = 30) -> DataFrame:
    """Per plate and window: extent of movement, first and last row, any entry?

    Aggregates combine map-side, so a plate with very many rows costs one
    summary row per window in the shuffle.
    """
    first = F.struct("ts", "id", "x", "y", "site", "level", "spot", "object_id", "license")
    last = F.struct("ts", "id", "video")
    return (
        on_the_way(df)
        .groupBy("plate", F.window("ts", f"{window_s} seconds").alias("w"))
        .agg(
            F.min_by(first, F.struct(*ORDER)).alias("first"),
            F.max_by(last, F.struct(*ORDER)).alias("last"),
            F.min("x").alias("x_min"), F.max("x").alias("x_max"),
            F.min("y").alias("y_min"), F.max("y").alias("y_max"),
            F.max(F.col("type") == "entry").alias("has_entry"),
        )
        .withColumn("window_start", F.col("w.start"))
        .drop("w")
    )


def stalled_windows(df: DataFrame, window_s: int = 30, extent: float = 4.0,
                    min_s: float = 20.0) -> DataFrame:
    """Windows in which a vehicle was seen ``min_s`` or longer and did not move."""
    span = F.unix_millis("last.ts") - F.unix_millis("first.ts")
    return (
        motion_windows(df, window_s)
        .where(
            (F.col("x_max") - F.col("x_min") <= extent)
            & (F.col("y_max") - F.col("y_min") <= extent)
            & (span >= int(min_s * 1000))
        )
        .select(
            "plate", "window_start",
            *[F.col(f"first.{c}").alias(c) for c in ("site", "level", "spot", "object_id", "license")],
            F.col("first.ts").alias("start_ts"),
            F.col("last.ts").alias("end_ts"),
            F.when(F.col("has_entry"), F.lit("")).otherwise(F.col("last.video")).alias("video"),
        )
    )


def advance_stop(state: dict | None, w: dict, extent: float, min_s: float, stale_s: float):
    """One window of one plate: (new state, found or None).

    ``state``: anchor (first row of the stop), last_ms (time of its newest row),
    video, and ``armed`` - whether the idle timer runs.
    ``w``: window summary, times in milliseconds.
    """
    if state is not None and w["first_ms"] - state["last_ms"] > stale_s * 1000:
        if not state["armed"]:  # moved, then silent: this window only ends the state
            return None, None
        state = None  # the timer had already ended it
    if state is None:
        if w["x_max"] - w["x_min"] > extent or w["y_max"] - w["y_min"] > extent:
            return None, None
        state = {"anchor": w["first"], "video": "" if w["has_entry"] else w["video"]}
        found = w["last_ms"] - w["first"]["ms"] >= min_s * 1000
    else:
        a = state["anchor"]
        dx = max(w["x_max"], a["x"]) - min(w["x_min"], a["x"])
        dy = max(w["y_max"], a["y"]) - min(w["y_min"], a["y"])
        found = w["last_ms"] - a["ms"] >= min_s * 1000 and dx < extent and dy < extent
        if not found:
            return {**state, "armed": False}, None
        if state["video"] != "":
            state = {**state, "video": "" if w["has_entry"] else w["video"]}
    state = {**state, "last_ms": w["last_ms"], "armed": True}
    hit = {**state["anchor"], "end_ms": w["last_ms"], "video": state["video"]}
    return state, hit if found else None


#: Windows' time that runs of one Python group begin in.
STRETCH = 1000
WHO = ("site", "level", "spot", "object_id", "license")
BOUNDS = ("x_min", "x_max", "y_min", "y_max")
EPISODE = "plate string, window_start timestamp, " + "".join(
    f"{c} string, " for c in WHO
) + "start_ms long, end_ms long, video string"


def window_summaries(df: DataFrame, window_s: int = 30) -> DataFrame:
    """Motion windows with the columns :func:`advance_stop` needs, flat."""
    return motion_windows(df, window_s).select(
        "plate", "window_start", *BOUNDS, "has_entry",
        F.unix_millis("first.ts").alias("ms"), F.col("first.x").alias("x"),
        F.col("first.y").alias("y"), *[F.col(f"first.{c}").alias(c) for c in WHO],
        F.unix_millis("last.ts").alias("last_ms"),
        F.coalesce("last.video", F.lit("")).alias("video"),
    )


def summary_facts(row) -> dict:
    """A summary row in the form :func:`advance_stop` takes."""
    first = {c: getattr(row, c) for c in ("ms", "x", "y", *WHO)}
    facts = {c: getattr(row, c) for c in (*BOUNDS, "has_entry", "last_ms", "video")}
    return {"first": first, "first_ms": row.ms, **facts}


def stalled_episodes(df: DataFrame, window_s: int = 30, extent: float = 4.0, min_s: float = 20.0,
                     stale_s: float = 300.0) -> DataFrame:
    """Stops followed over windows: reported again as long as the vehicle stays put.

    A plate is cut into runs where it is silent for longer than ``stale_s``. Only
    one bit crosses such a gap: whether a vehicle that had moved on was still
    followed, so that the first window after it only ends that. Each run is
    followed for both values of the bit, on its own and in parallel; the bits are
    then passed along the runs of a plate, one short row each, and choose the
    results, which come in order of plate and time. Python sees one summary row per plate and window, never the detections.
    """
    stale_ms = int(stale_s * 1000)
    rows = marked(
        cut(window_summaries(df, window_s)), ["plate"], ["window_start"], F.col("last_ms"),
        lambda get, before: F.when(before.isNull() | (get("ms") - before > stale_ms), get("ms")), ["ms"], STRETCH * window_s,
    ).drop("before").withColumnRenamed("last_mark", "run")
    rows = rows.withColumn("block", F.floor(F.col("run") / (STRETCH * window_s * 1000)))
    names = ["run", "after_move", "moved", *[c.split()[0] for c in EPISODE.split(", ")]]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run, group in groupby(pdf.sort_values("window_start").itertuples(index=False), attrgetter("run")):
            windows = list(group)
            for after_move in (False, True):
                state = None
                for r in windows[after_move:]:
                    state, hit = advance_stop(state, summary_facts(r), extent, min_s, stale_s)
                    if hit:
                        out.append((run, after_move, None, r.plate, r.window_start, *[hit[c] for c in WHO],
                                    hit["ms"], hit["end_ms"], hit["video"]))
                moved = state is not None and not state["armed"]
                out.append((run, after_move, moved, windows[0].plate, *[None] * (len(names) - 4)))
        return pd.DataFrame(out, columns=names)

    found = cut(python_groups(rows, "plate", "block").groupBy("plate", "block").applyInPandas(
        follow, f"run long, after_move boolean, moved boolean, {EPISODE}"
    ))
    ends = found.where("moved is not null").groupBy("plate", "run").agg(
        F.max(F.when(~F.col("after_move"), F.col("moved"))).alias("_off"), F.max(F.when(F.col("after_move"), F.col("moved"))).alias("_on"),
    )
    # a run sets the bit, keeps it or turns it: the last one that set it, and the turns since
    w = W.partitionBy("plate").orderBy("run")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("_off") & ~F.col("_on")).cast("long")).over(w), F.lit(0))
    counted = ends.withColumn("_turns", turns).withColumns({
        "_set": F.last(F.when(F.col("_off") == F.col("_on"), F.struct("_off", "_turns")), ignorenulls=True).over(past),
        "_before": F.coalesce(F.lag("_turns").over(w), F.lit(0)),
    })
    odd = (F.col("_before") - F.coalesce("_set._turns", F.lit(0))) % 2 == 1
    bits = counted.select("plate", "run", (F.coalesce("_set._off", F.lit(False)) != odd).alias("after_move"))
    return found.where("moved is null").join(bits, ["plate", "run", "after_move"]).select(
        "plate", "window_start", *WHO,
        F.timestamp_millis("start_ms").alias("start_ts"),
        F.timestamp_millis("end_ms").alias("end_ts"), "video",
    ).orderBy("plate", "window_start", "end_ts")
