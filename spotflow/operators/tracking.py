"""Detections of several cameras → vehicles followed over time.

Everything is keyed by site, level and a short frame of time. Python runs for
single frames only, and only for those that have something to decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from spotflow.functions.columns import as_ts, camera_point, cell, euclid
from spotflow.operators.assign import best_pairing, complete_linkage, near_arrays, near_pairs
from spotflow.operators.graphs import chain_heads, connected_components
from spotflow.operators.lineage import cut, python_groups
from spotflow.operators.occupancy import SPOT_KEY, latest_per_key, spot_events
from spotflow.operators.ordered import SLICE, before, marked, numbered
from spotflow.operators.regions import spread
from spotflow.operators.tracks import heading

PLACE = ["site", "level"]
FRAME_KEY = [*PLACE, "frame"]


def frames(df: DataFrame, seconds: float = 0.5) -> DataFrame:
    """Add ``frame``, the number of the time bin, counted from the epoch."""
    return df.withColumn("frame", F.floor(F.unix_micros("ts") / int(seconds * 1e6)).cast("long"))


def collapse_frame(df: DataFrame) -> DataFrame:
    """Per camera and object the newest detection of each frame."""
    return latest_per_key(df, [*FRAME_KEY, "sensor", "object_id"], ["ts", "id"]).select(*df.columns)


# -- cameras ------------------------------------------------------------------------


def both_directions(edges: DataFrame) -> DataFrame:
    """(sensor, other) pairs, each in both directions, once."""
    return edges.select("sensor", "other").unionByName(
        edges.select(F.col("other").alias("sensor"), F.col("sensor").alias("other"))
    ).distinct()


def conflicting_cameras(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``conflict``: the two cameras are listed as never seeing one vehicle at a time.

    ``pairs`` has sensor1 and sensor2; ``edges`` (sensor, other), either way round.
    """
    known = both_directions(edges).select(
        F.col("sensor").alias("sensor1"), F.col("other").alias("sensor2"), F.lit(True).alias("_hit")
    )
    return pairs.join(known, ["sensor1", "sensor2"], "left").select(
        *pairs.columns, F.coalesce("_hit", F.lit(False)).alias("conflict")
    )


def without_conflicts(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    known = both_directions(edges).toDF("sensor1", "sensor2")
    return pairs.join(known, ["sensor1", "sensor2"], "left_anti").select(*pairs.columns)


def overlapping_cameras(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``overlap``: listed as seeing one spot, or neither camera is listed at all."""
    known = both_directions(edges)
    listed = known.select("sensor").distinct()
    hit = known.select(F.col("sensor").alias("sensor1"), F.col("other").alias("sensor2"), F.lit(True).alias("_hit"))
    one = listed.select(F.col("sensor").alias("sensor1"), F.lit(True).alias("_l1"))
    two = listed.select(F.col("sensor").alias("sensor2"), F.lit(True).alias("_l2"))
    return (
        pairs.join(hit, ["sensor1", "sensor2"], "left").join(one, "sensor1", "left").join(two, "sensor2", "left")
        .select(
            *pairs.columns,
            (F.col("_hit").isNotNull() | (F.col("_l1").isNull() & F.col("_l2").isNull())).alias("overlap"),
        )
    )


# -- pairs ------------------------------------------------------------------------------

_SIDE = ("id", "sensor", "x", "y")


def pairs_within_frame(df: DataFrame, max_d: float, other_camera: bool = True) -> DataFrame:
    """Detections of one frame no farther apart than ``max_d``: (…, id1, id2, distance).

    Only rows in neighbouring grid cells meet.
    """
    cols = [*FRAME_KEY, *_SIDE]
    a = df.select(*cols, cell("x", max_d).alias("_cx"), cell("y", max_d).alias("_cy"))
    b = spread(df.select(*cols), max_d)
    keys = [*FRAME_KEY, "_cx", "_cy"]
    a = a.select(*keys, *[F.col(c).alias(f"{c}1") for c in _SIDE])
    b = b.select(*keys, *[F.col(c).alias(f"{c}2") for c in _SIDE])
    near = a.join(b, keys).where(F.col("id1") < F.col("id2"))
    if other_camera:
        near = near.where(F.col("sensor1") != F.col("sensor2"))
    return (
        near.withColumn("distance", euclid("x1", "y1", "x2", "y2"))
        .where(F.col("distance") <= max_d)
        .select(*FRAME_KEY, "id1", "id2", "sensor1", "sensor2", "distance")
    )


def _joined(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The further columns of ``more``, one row a key; null is a key like any other."""
    return rows.join(more.withColumnRenamed(key, "_key"), F.expr(f"{key} <=> _key")).drop("_key")


def frame_to_frame_candidates(df: DataFrame, max_d: float, conflicts: DataFrame | None = None,
                              ahead: DataFrame | None = None, back: DataFrame | None = None) -> DataFrame:
    """Rows of a frame with rows of the next one that may be the same vehicle.

    Within ``max_d``, cost = distance; 0 at any distance where the two carry a
    common id. ``df`` may have ``ids`` (array); else the object id counts.
    ``ahead`` (id1, …) and ``back`` (id2, …): further columns by id, added to the rows before
    they meet, so that a filter on them works while pairs are made. Ids they lack make no pairs.
    """
    ids = F.col("ids") if "ids" in df.columns else F.array("object_id")
    base = df.select(*FRAME_KEY, *_SIDE, ids.alias("ids"))
    side = (*_SIDE, "ids")
    now = base.select(*FRAME_KEY, *[F.col(c).alias(f"{c}2") for c in side])
    prev = base.withColumn("frame", F.col("frame") + 1).select(
        *FRAME_KEY, *[F.col(c).alias(f"{c}1") for c in side]
    )
    further = [c for more in (ahead, back) if more is not None for c in more.columns if c not in ("id1", "id2")]
    prev = prev if ahead is None else _joined(prev, ahead, "id1")
    now = now if back is None else _joined(now, back, "id2")
    keys = [*FRAME_KEY, "_cx", "_cy"]
    near = prev.select(
        "*", cell("x1", max_d).alias("_cx"), cell("y1", max_d).alias("_cy")
    ).join(spread(now, max_d, "x2", "y2"), keys).drop("_cx", "_cy")
    same = (
        prev.withColumn("_o", F.explode("ids1"))
        .join(now.withColumn("_o", F.explode("ids2")), [*FRAME_KEY, "_o"])
        .drop("_o")
    )
    shared = F.arrays_overlap("ids1", "ids2")
    d = euclid("x1", "y1", "x2", "y2")
    near = near.withColumn("distance", d).where((F.col("distance") <= max_d) & ~shared)
    same = same.withColumn("distance", d).dropDuplicates([*FRAME_KEY, "id1", "id2"])
    both = near.withColumn("cost", F.col("distance")).unionByName(same.withColumn("cost", F.lit(0.0)))
    out = both.select(*FRAME_KEY, "id1", "id2", "sensor1", "sensor2", "distance", "cost", *further)
    return without_conflicts(out, conflicts) if conflicts is not None else out


def _least(column: str, name: str):
    """The least value; null, where there is one, comes first."""
    return F.when(~F.bool_or(F.isnull(column)), F.min(column)).alias(name)


def match_mutual_nearest(candidates: DataFrame, among: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Pairs that are each other's cheapest partner. Aggregates and joins only.

    Least costs, and then least ids at just that cost, are folded by hash as pairs stream by; no task
    sorts or holds pairs. ``among(ahead=…)`` and ``among(back=…)`` give the candidates again with the further
    columns of :func:`frame_to_frame_candidates`; without it ``candidates`` are joined, which sends all pairs.
    """
    def joined(ahead: DataFrame | None = None, back: DataFrame | None = None) -> DataFrame:
        return _joined(candidates, (back if ahead is None else ahead).hint("shuffle_hash"), "id1" if back is None else "id2")

    among = among or joined
    cost1 = candidates.groupBy("id1").agg(_least("cost", "_least"))
    cost2 = candidates.groupBy("id2").agg(_least("cost", "_least"))
    ahead = among(ahead=cost1).where("cost <=> _least").groupBy("id1").agg(_least("id2", "id2"))
    back = among(back=cost2).where("cost <=> _least").groupBy("id2").agg(_least("id1", "id1"))
    mutual = ahead.join(back, ["id1", "id2"]).select("id1", F.col("id2").alias("_partner"))
    rest = [c for c in candidates.columns if c not in ("id1", "id2")]
    return among(ahead=mutual).where("id2 = _partner").select("id1", "id2", *rest)


# -- clusters ---------------------------------------------------------------------------


def near_pairs_of_frames(df: DataFrame, max_d: float, conflicts: DataFrame | None = None,
                         overlaps: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """Pairs of a frame that may be one vehicle: near enough or known to be one, of compatible cameras."""
    pairs = pairs_within_frame(df, max_d)
    if same is not None:
        rooted = df.join(same.withColumnRenamed("member", "object_id"), "object_id")
        side = [*FRAME_KEY, "root"]
        a = rooted.select(*side, F.col("id").alias("id1"), F.col("sensor").alias("sensor1"))
        b = rooted.select(*side, F.col("id").alias("id2"), F.col("sensor").alias("sensor2"))
        known = a.join(b, side).where("id1 < id2 and sensor1 <> sensor2").drop("root")
        pairs = (
            pairs.unionByName(known.withColumn("distance", F.lit(0.0)))
            .groupBy(*[c for c in pairs.columns if c != "distance"])
            .agg(F.min("distance").alias("distance"))
        )
    if conflicts is not None:
        pairs = without_conflicts(pairs, conflicts)
    if overlaps is not None:
        pairs = overlapping_cameras(pairs, overlaps).where("overlap").drop("overlap")
    return pairs


def cluster_frame(df: DataFrame, max_d: float, conflicts: DataFrame | None = None,
                  overlaps: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """Complete-linkage clusters of each frame's detections: adds ``cluster``.

    Members of a cluster come from different, compatible cameras and are all
    within ``max_d`` of each other. ``same`` (member, root): object ids known to be one vehicle;
    their distance counts as 0. A cluster is named after its first id.

    Python gets pairs near enough to merge. Rows without such a pair never leave the JVM.
    """
    pairs = near_pairs_of_frames(df, max_d, conflicts, overlaps, same)
    id_type = dict(df.dtypes)["id"]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.groupby("frame", sort=False):
            one, two = rows["id1"].to_numpy(), rows["id2"].to_numpy()
            ids = np.unique(np.concatenate([one, two]))
            near = zip(np.searchsorted(ids, one), np.searchsorted(ids, two), rows["distance"])
            label = complete_linkage(len(ids), near, max_d)
            out += [(v, ids[k]) for v, k in zip(ids, label)]
        return pd.DataFrame(out, columns=["id", "cluster"])

    block = [*PLACE, "block"]
    blocks = pairs.withColumn("block", F.floor(F.col("frame") / BLOCK))
    found = python_groups(blocks, *block).groupBy(*block).applyInPandas(link, f"id {id_type}, cluster {id_type}")
    return df.join(found, "id", "left").select(
        *df.columns, F.coalesce("cluster", "id").alias("cluster")
    )


def cluster_representative(df: DataFrame, key: str = "cluster") -> DataFrame:
    """The row that stands for a cluster.

    The last entry/exit row; else the last row with a video; else the smallest object id.
    """
    row = F.struct(*[c for c in df.columns if c != key])
    order = F.struct("ts", "id")
    gate = F.col("type").isin("entry", "exit")
    return (
        df.groupBy(key)
        .agg(
            F.coalesce(
                F.max_by(row, F.when(gate, order)),
                F.max_by(row, F.when(F.col("video") != "", order)),
                F.min_by(row, F.struct("object_id", "ts", "id")),
            ).alias("r")
        )
        .select(key, "r.*")
    )


def cluster_position(df: DataFrame, key: str = "cluster", how: str = "nearest") -> DataFrame:
    """One position per cluster: (cluster, x, y).

    ``nearest``: that of the detection nearest its camera, which is the one
    lowest in its picture (bbox columns); or ``mean``, ``median``.
    """
    if how == "mean":
        aggs = [F.avg(c).alias(c) for c in ("x", "y")]
    elif how == "median":
        aggs = [F.percentile(c, F.lit(0.5)).alias(c) for c in ("x", "y")]
    else:
        _, low = camera_point("bbox_left", "bbox_top", "bbox_right", "bbox_bottom")
        best = F.min_by(F.struct("x", "y"), F.struct((-low).alias("l"), "ts", "id"))
        return df.groupBy(key).agg(best.alias("p")).select(key, "p.x", "p.y")
    return df.groupBy(key).agg(*aggs)


def merge_attributes(df: DataFrame, key: str = "cluster") -> DataFrame:
    """Plate and object id of a cluster's only known vehicle, copied to all its rows.

    With several known plates nothing is copied; with none the first row counts.
    """
    known = F.coalesce("license", F.lit("")) != ""
    order = F.struct("ts", "id")
    who = F.struct("license", "object_id")
    seen = df.groupBy(key).agg(
        F.min(F.when(known, F.col("license"))).alias("_lo"),
        F.max(F.when(known, F.col("license"))).alias("_hi"),
        F.min_by(who, F.when(known, order)).alias("_known"),
        F.min_by(who, order).alias("_first"),
    ).select(
        key,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_known"))
        .when(F.col("_lo").isNull(), F.col("_first"))
        .alias("_who"),
    )
    rest = [c for c in df.columns if c not in ("license", "object_id")]
    return df.join(seen, key).select(
        *rest,
        F.when(F.col("_who").isNotNull(), F.col("_who.license")).otherwise(F.col("license")).alias("license"),
        F.when(F.col("_who").isNotNull(), F.col("_who.object_id")).otherwise(F.col("object_id")).alias("object_id"),
    ).select(*df.columns)


def cluster_output(df: DataFrame) -> DataFrame:
    """One row per cluster seen by several cameras, other rows as they are; adds ``ids``.

    The row is the representative at the cluster's position, with merged
    attributes and the object ids of all members.
    """
    own = F.array("object_id").alias("ids")
    cameras = df.groupBy("cluster").agg(F.min("sensor").alias("_a"), F.max("sensor").alias("_b"))
    several = cameras.where("_a <> _b").select("cluster")
    many = df.join(several, "cluster", "left_semi").select(*df.columns)
    alone = df.join(several, "cluster", "left_anti").select(*df.columns, own)
    rep = cluster_representative(merge_attributes(many))
    has_box = "bbox_bottom" in df.columns
    place = cluster_position(many, how="nearest" if has_box else "mean")
    ids = many.groupBy("cluster").agg(F.array_sort(F.collect_set("object_id")).alias("ids"))
    rest = [c for c in df.columns if c not in ("x", "y", "cluster")]
    merged = (
        rep.select("cluster", *rest).join(place, "cluster").join(ids, "cluster")
        .select(*df.columns, "ids")
    )
    return alone.unionByName(merged)


def id_sets(clustered: DataFrame) -> DataFrame:
    """Object ids that were ever in one cluster: (member, root, size, updated)."""
    seen = clustered.select("cluster", "object_id").distinct()
    first = seen.groupBy("cluster").agg(F.min("object_id").alias("a"))
    pairs = seen.join(first, "cluster").select("a", F.col("object_id").alias("b"))
    return set_table(connected_components(pairs), clustered)


def live_sets(sets: DataFrame, now, keep_s: float = 20.0) -> DataFrame:
    """Sets that were seen within ``keep_s`` before ``now``; older ones are forgotten."""
    age = F.unix_micros(as_ts(now)) - F.unix_micros("updated")
    return sets.where(age <= int(keep_s * 1e6))


def set_table(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Size and newest time of each id set."""
    seen = rows.groupBy(F.col("object_id").alias("member")).agg(F.max("ts").alias("_ts"))
    stats = (
        groups.join(seen, "member", "left").groupBy("root")
        .agg(F.count(F.lit(1)).alias("size"), F.max("_ts").alias("updated"))
    )
    return groups.join(stats, "root").select("member", "root", "size", "updated")


# -- spots ------------------------------------------------------------------------------


def departed_vehicle(df: DataFrame, width: float = SLICE) -> DataFrame:
    """For each ``empty`` event the vehicle that leaves the spot.

    That is the first one parked there since the spot was last empty, now with
    place, sensor and time of the empty event.
    """
    who = ["id", "license", "object_id", "x", "y", "ts"]

    def arrives(get, before):
        fresh = (get("type") == "parked") & (before.isNull() | (before == "empty"))
        return F.when(fresh, F.struct(*[get(c).alias(c) for c in who]))

    rows = marked(spot_events(df), SPOT_KEY, ["ts", "id"], F.col("type"), arrives, ["type", *who], width)
    return rows.where((F.col("type") == "empty") & (F.col("before") == "parked")).select(
        "id", "ts", *SPOT_KEY, "sensor", F.col("last_mark.id").alias("parked_id"),
        *[F.col(f"last_mark.{c}").alias(c) for c in ("license", "object_id", "x", "y")],
        F.col("last_mark.ts").alias("parked_ts"),
    )


# -- matching frame to frame ---------------------------------------------------------------


def _frame_list(rows: DataFrame, width: float) -> DataFrame:
    """Numbered frames of each site and level, with the time of their first row."""
    listed = rows.groupBy(*FRAME_KEY).agg(F.min("ts").alias("at"))
    listed = numbered(listed, PLACE, ["at", "frame"], "no", width=width)
    later = listed.select(*PLACE, (F.col("no") + 1).alias("no"), F.col("at").alias("at_before"))
    return listed.join(later, [*PLACE, "no"], "left")


def _conflict_lists(rows: DataFrame, conflicts: DataFrame | None) -> DataFrame:
    if conflicts is None:
        return rows.withColumn("conflicts", F.array().cast("array<string>"))
    lists = both_directions(conflicts).groupBy("sensor").agg(
        F.array_sort(F.collect_set("other")).alias("conflicts")
    )
    return rows.join(lists, "sensor", "left")


def _assign(old: dict, new: dict, max_d: float) -> list[tuple]:
    """(earlier id, later id, distance) of one frame.

    Pairs that may be one vehicle are the near ones, and those with a common id
    (cost 0). A frame takes as many of them as fit one to one, and of all ways
    to do so the one of least squared distances: a row that stays alone costs
    more than all pairs of the frame can.
    """
    i, j, d = near_arrays(old["x"], old["y"], new["x"], new["y"], max_d)
    holders: dict = {}
    for k, ids in enumerate(old["ids"]):
        for v in ids:
            holders.setdefault(v, []).append(k)
    n = len(new["id"])
    same = np.array(sorted({k * n + at for at, ids in enumerate(new["ids"]) for v in ids for k in holders.get(v, ())}), np.int64)
    other = ~np.isin(i * n + j, same)
    i, j = np.concatenate([i[other], same // n]), np.concatenate([j[other], same % n])
    cost = np.concatenate([(d * d)[other], np.zeros(len(same))])
    code: dict = {}
    seen = np.array([code.setdefault(v, len(code)) for v in new["sensor"]], np.int64)
    barred = [k * len(code) + code[v] for k, vs in enumerate(old["conflicts"]) if vs is not None for v in vs if v in code]
    if barred:
        may = ~np.isin(i * len(code) + seen[j], barred)
        i, j, cost = i[may], j[may], cost[may]
    order = np.lexsort((j, cost, i))
    listed = list(zip(j[order].tolist(), cost[order].tolist()))
    ends = np.searchsorted(i[order], np.arange(len(old["id"]) + 1)).tolist()
    options = [listed[a:b] for a, b in zip(ends, ends[1:])]
    lone = (1 + len(options)) * max_d * max_d
    return [
        (old["id"][i], new["id"][j], float(np.hypot(old["x"][i] - new["x"][j], old["y"][i] - new["y"][j])))
        for i, j in best_pairing(options, lone)
    ]


# Consecutive frames that one call of the Python function works through.
BLOCK = 64

# Times the frames a row may be carried over that are worked through before a block, to guess what comes into it.
WARM = 2

# Blocks are guessed ahead only where the largest place is more than this many times the share of one core.
FOLD = 3


def _assign_block(pdf: pd.DataFrame, first: int, max_d: float, carry_us: int, reach: int,
                  used: set | None = None) -> tuple[list[tuple], list]:
    """(frame no, earlier id, later id, distance) for consecutive frames of one place from ``first`` on, and the ids
    of rows offered to them that found a partner in the frames before, which are worked through as well.

    A row that found its partner is not offered to later frames; ``used``: those that did so before, to which
    the ones found here are added. Where rows tell what an earlier run made of them (``was``: taken for gone
    then; rows with ``met`` are its pairs: no, mate, id, apart), its pairs stand from the frame on that finds the same rows open.
    """
    known = "met" in pdf
    if known:
        earlier = pdf[pdf["met"]].sort_values("no", kind="stable")
        pdf = pdf[~pdf["met"]]
        mate, mate_no = earlier["mate"].to_numpy(), earlier["no"].to_numpy()
        then = set(pdf["id"][pdf["was"]])
    pdf = pdf.sort_values(["us", "id"], kind="stable")
    cols = {c: pdf[c].to_numpy() for c in ("id", "x", "y", "ids", "sensor", "conflicts")}
    name, no, us, since = cols["id"], pdf["no"].to_numpy(), pdf["us"].to_numpy(), pdf["since"].to_numpy(float)
    carried = pdf["carried"].to_numpy().astype(bool)
    places = np.flatnonzero(~carried)
    places = places[np.argsort(no[places], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, no[places][1:] != no[places][:-1], True]) if len(places) else [0]
    used = set() if used is None else used
    found, told, open_ = [], [], np.flatnonzero(carried)
    for a, b in zip(cuts[:-1], cuts[1:]):
        fresh = places[a:b]
        at = no[fresh[0]]
        young = (no[open_] + 1 == at) | (since[fresh[0]] - us[open_] <= carry_us)
        open_ = open_[young & (at - no[open_] <= reach)]
        if at == first:
            told = [name[k] for k in open_ if name[k] in used]
        if known:
            if all((name[k] in used) == (name[k] in then) for k in open_):
                rest = earlier[mate_no >= at]
                used.update(rest["mate"])
                found += rest[["no", "mate", "id", "apart"]].itertuples(index=False, name=None)
                break
            then.update(mate[mate_no == at])
            open_ = np.array([k for k in open_ if name[k] not in used or name[k] not in then], np.int64)
            free = np.array([k for k in open_ if name[k] not in used], np.int64)
        else:
            free = open_ = np.array([k for k in open_ if name[k] not in used], np.int64)
        if len(free):
            pairs = _assign({c: v[free] for c, v in cols.items()}, {c: v[fresh] for c, v in cols.items()}, max_d)
            used.update(p[0] for p in pairs)
            if at >= first:
                found += [(at, *p) for p in pairs]
        open_ = np.sort(np.concatenate([open_, fresh]))
    return found, told


def _whole_groups(parts, keys: list[str]):
    """(key, rows) of each group, from parts of rows that are sorted by the keys."""
    last, held = None, []
    for pdf in parts:
        starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1))
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            key = tuple(pdf[c].iat[a] for c in keys)
            if held and key != last:
                yield last, pd.concat(held, ignore_index=True)
                held = []
            last = key
            held.append(pdf.iloc[a:b])
    if held:
        yield last, pd.concat(held, ignore_index=True)


def match_frames(rows: DataFrame, max_d: float = 20.0, carry_s: float = 3.0,
                 frame_s: float = 0.5, conflicts: DataFrame | None = None,
                 width: float = SLICE, carried: DataFrame | None = None) -> DataFrame:
    """Which row of an earlier frame is which row of a later one: (prev_id, id, …).

    Each frame is matched with the frame before it and with earlier rows that
    found no partner and are no older than ``carry_s``: a one-to-one assignment
    at minimum squared distance, pairs beyond ``max_d`` or of conflicting
    cameras excluded, rows with a common id at distance 0.

    What is carried into a frame depends on the frames before it. Where places are few for the cores, blocks of consecutive
    frames are worked through in parallel, at first after some frames before them
    that only show which rows have found a partner by then. Blocks for which that was wrong are done
    again, until nothing changes: neighbouring ones one after the other, as what comes out of one goes into the next,
    and each up to the frame that finds the same rows open as before. A block is final once the ones before it
    are, so the fixed point is the result of the sequential fold. Where crowded frames hand a wrong guess on from block to block that
    is work done twice; so where places suffice for the cores, the blocks of each are done in their order at once. Either way Python
    never sees more than a block of one place with what is carried into it. A row goes to its own
    block and to those that begin within its reach, once each.
    ``carried``: rows an earlier run left open; they are offered to the first frames.
    """
    rows = rows if "ids" in rows.columns else rows.withColumn("ids", F.array("object_id"))
    spark = rows.sparkSession
    point = ("id", "us", "sensor", "x", "y", "ids")
    us = F.unix_micros("ts").alias("us")
    base = _conflict_lists(rows.select("*", us).select(*FRAME_KEY, *point), conflicts)
    order = cut(_frame_list(rows, width).select(*FRAME_KEY, "no", F.unix_micros("at_before").alias("since")))
    here = base.join(order, FRAME_KEY).drop("frame").withColumn("carried", F.lit(False))
    if carried is not None:
        open_rows = _conflict_lists(carried.select("*", us).select(*PLACE, *point), conflicts)
        here = here.unionByName(open_rows.select(
            "*", F.lit(0).cast("long").alias("no"), F.lit(None).cast("long").alias("since"), F.lit(True).alias("carried")
        ))
    here = cut(here)
    carry_us, reach = int(carry_s * 1e6), math.ceil(carry_s / frame_s) + 2
    block = [*PLACE, "block"]

    def sent(ahead: int) -> DataFrame:
        """Rows with their block, and with those that begin so many frames after them."""
        last = F.floor((F.col("no") + ahead) / BLOCK)
        return here.withColumn("block", F.explode(F.sequence(F.floor(F.col("no") / BLOCK), last)))

    starts = order.where(F.col("no") % BLOCK == 0).select(
        *PLACE, F.floor(F.col("no") / BLOCK).alias("block"), F.col("since").alias("_since")
    )
    offers = (
        sent(reach).where(F.col("no") < F.col("block") * BLOCK).join(starts, block)
        .where((F.col("no") + 1 == F.col("block") * BLOCK) | (F.col("_since") - F.col("us") <= carry_us))
        .drop("_since").withColumn("carried", F.lit(True))
    )
    id_type = dict(rows.dtypes)["id"]
    names = ["site", "level", "block", "no", "prev_id", "id", "distance"]
    schema = f"site string, level string, block long, no long, prev_id {id_type}, id {id_type}, distance double"

    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, told = _assign_block(pdf, key[2] * BLOCK, max_d, carry_us, reach)
        out = [(*key, *p) for p in found] + [(*key, -1, v, v, 0.0) for v in told]
        return pd.DataFrame(out, columns=names)

    def chain(parts):
        """Runs of blocks in their order; the ids of rows that found a partner go on from block to block."""
        run, used = None, set()
        for key, pdf in _whole_groups(parts, [*PLACE, "run", "block"]):
            if key[:3] != run:
                run, used = key[:3], set(pdf["id"][pdf["gone"]])
            found, _ = _assign_block(pdf, key[3] * BLOCK, max_d, carry_us, reach, used)
            used &= set(pdf["id"])
            yield pd.DataFrame([(*key[:2], key[3], *p) for p in found], columns=names)

    def chained(group: DataFrame) -> DataFrame:
        spread_out = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # runs differ in length
        keys = [*PLACE, "run"]
        return group.repartitionByRange(spread_out, *keys).sortWithinPartitions(*keys, "block").mapInPandas(chain, schema)

    total, largest = here.groupBy(*PLACE).count().agg(F.sum("count"), F.max("count")).first()
    if not total or largest * spark.sparkContext.defaultParallelism <= FOLD * total:
        all_rows = offers.unionByName(sent(0)).withColumns({"run": F.lit(0).cast("long"), "gone": F.lit(False)})
        return cut(chained(all_rows)).drop("block")

    done = cut(python_groups(sent(WARM * reach), *block).groupBy(*block).applyInPandas(assign, schema))
    pairs = done.where("no >= 0")
    taken_for = done.where("no < 0").select(*block, "id", F.lit(True).alias("_was")).distinct()  # what each block took for gone
    told = offers.join(taken_for, [*block, "id"], "left").withColumn("was", F.coalesce("_was", F.lit(False))).drop("_was")
    while True:
        taken = pairs.groupBy(F.col("prev_id").alias("id")).agg(F.min("no").alias("_no"))
        gone = F.coalesce(F.floor(F.col("_no") / BLOCK) < F.col("block"), F.lit(False))
        told = cut(told.join(taken, "id", "left").withColumn("gone", gone).drop("_no"))
        wrong = told.where("gone <> was").select(*block).distinct()
        # neighbours get one number
        todo = cut(wrong.withColumn("run", F.col("block") - F.row_number().over(W.partitionBy(*PLACE).orderBy("block"))))
        if todo.isEmpty():
            return pairs.drop("block")
        found = pairs.select(*block, "no", "id", F.col("prev_id").alias("mate"), F.col("distance").alias("apart"), F.lit(True).alias("met"))
        group = told.unionByName(sent(0), allowMissingColumns=True).unionByName(found, allowMissingColumns=True).withColumns({
            **{c: F.coalesce(c, F.lit(False)) for c in ("carried", "gone", "was", "met")},
            "us": F.coalesce("us", F.lit(0).cast("long")), "mate": F.coalesce("mate", "id"),
        })
        fresh = chained(group.join(todo, block)).select(*names)
        pairs = cut(pairs.join(todo, block, "left_anti").select(*names).unionByName(fresh))
        told = told.withColumn("was", F.col("gone")).drop("gone")


def label_tracks(rows: DataFrame, pairs: DataFrame, width: float = SLICE,
                 carried: DataFrame | None = None, made: DataFrame | None = None) -> DataFrame:
    """Carry plate and object id along matched rows; adds ``track_id``, ``heading``, ``prev_id``.

    A row without plate takes that of the row before it; with the same plate
    it takes its object id. A chain that starts without a plate gets a made-up
    one (UNK-M-n, counted per site and level). ``carried``: labelled rows of an
    earlier run which chains may start from; ``made`` (site, level, made): how
    many plates it made up.
    """
    links = pairs.select("prev_id", "id")
    order = ["ts", "id"]
    base = rows.withColumn("_track", F.lit(None).cast(dict(rows.dtypes)["id"])).withColumn(
        "_turn", F.lit(None).cast("double")
    )
    if carried is not None:
        base = base.unionByName(
            carried.select(*rows.columns, F.col("track_id").alias("_track"), F.col("heading").alias("_turn"))
        )
    heads = chain_heads(links, base).withColumnRenamed("head", "_head")
    known = base.where("_track is not null").select(F.col("id").alias("_head"), F.col("_track").alias("_known"))
    chained = base.join(heads, "id").join(links, "id", "left").join(known, "_head", "left")
    blank = F.coalesce(F.trim("license"), F.lit("")) == ""
    unknown = numbered(
        chained.where(blank & F.col("prev_id").isNull() & F.col("_track").isNull()).select("id", *PLACE, "ts"),
        PLACE, order, "_n", width=width,
    )
    if made is not None:
        unknown = unknown.join(made, PLACE, "left").withColumn("_n", F.col("_n") + F.coalesce("made", F.lit(0)))
    unknown = unknown.select("id", F.concat(F.lit("UNK-M-"), (F.col("_n") - 1).cast("string")).alias("_made"))
    named = chained.join(unknown, "id", "left").withColumn(
        "_own", F.coalesce(F.when(~blank, F.col("license")), "_made")
    )
    past = cut(before(cut(named), ["_head"], order, {"_past": F.col("_own")}, width))
    starts = F.col("prev_id").isNull() | (
        F.col("_own").isNotNull() & ~F.col("_own").eqNullSafe(F.col("_past"))
    )
    marked = past.withColumn("_start", F.when(starts, F.struct("object_id"))).withColumn(
        "license", F.coalesce("_own", "_past")
    )
    run = before(marked, ["_head"], order, {"_run": F.col("_start")}, width)
    labelled = run.withColumn("object_id", F.coalesce("_start.object_id", "_run.object_id")).select(
        *rows.columns, "_head", "_track", "_turn", "prev_id",
        F.coalesce("_known", "_head").alias("track_id"), F.col("_made").isNotNull().alias("synthetic"),
    )
    turned = heading(cut(labelled), ["_head"], order, width, known="_turn")
    return turned.where("_track is null").drop("_head", "_track", "_turn")


# -- figures about a run ---------------------------------------------------------------------


def match_audit(pairs: DataFrame, tracked: DataFrame) -> DataFrame:
    """Matched points side by side; ``error`` where the plates still differ."""
    side = ("ts", "x", "y", "sensor", "license", "object_id")
    a = tracked.select(F.col("id").alias("prev_id"), *[F.col(c).alias(f"{c}1") for c in side])
    b = tracked.select("id", *[F.col(c).alias(f"{c}2") for c in side])
    return pairs.join(a, "prev_id").join(b, "id").withColumn(
        "error", (F.col("license1") != F.col("license2")).cast("int")
    )


def match_quality(audit: DataFrame, *by: str) -> DataFrame:
    """Matches and wrong matches per step."""
    return audit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.sum("error").cast("long").alias("errors")
    )


def latency_profile(df: DataFrame, delay_ms: str, *by: str) -> DataFrame:
    """Count, mean, deviation and percentiles of a delay in whole milliseconds.

    Exact percentiles keep one counter per distinct delay, not one per row.
    """
    cuts = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    ms = F.col(delay_ms).cast("long")
    return df.groupBy(*by).agg(
        F.count(ms).alias("count"), F.avg(ms).alias("mean"), F.stddev_samp(ms).alias("std"),
        F.min(ms).alias("min"),
        *[F.percentile(ms, F.lit(p)).alias(n) for n, p in cuts.items()],
        F.max(ms).alias("max"),
    )


def input_audit(kept: DataFrame, ignored: DataFrame, frame_s: float = 0.5) -> DataFrame:
    """Input points with their frame and whether a region made the tracker ignore them."""
    cols = ("id", "ts", "frame", "type", "x", "y", "sensor", "license", "object_id", "site", "level", "ignored")
    both = kept.withColumn("ignored", F.lit(0)).unionByName(ignored.withColumn("ignored", F.lit(1)))
    return frames(both, frame_s).select(*cols)


def cluster_audit(clustered: DataFrame) -> DataFrame:
    """Cluster points: which detection went into which cluster."""
    return clustered.select(*FRAME_KEY, "cluster", "id", "ts", "x", "y", "sensor", "license", "object_id")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
