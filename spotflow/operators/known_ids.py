"""Clusters that remember which object ids were one vehicle before.

Object ids that were in one cluster form a set per site and level. While a set is
alive, detections with its ids are at distance 0 of each other, wherever they are.
Every sighting of a member renews its set; a set whose members were not seen for
``keep_s`` before a frame begins is forgotten. Sets that meet in a cluster unite.

A frame's clusters thus depend on the frames before it. Blocks of consecutive
frames, each at least ``keep_s`` long, are worked through in parallel, at first with the
sets that a few frames before them give. Then each block gets the sets its predecessor ended with, and
those whose sets differ from what they had are done again, until none does. A block
is final once its predecessor is, so the result is that of going frame by frame.
No set outlives a block without sightings, so nothing older can come in.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spotflow.operators import tracking as tr
from spotflow.operators.assign import linked_places
from spotflow.operators.lineage import cut, python_groups

# Frames before a block that are worked through first, to guess which sets come into it.
WARM = 8
SETS = "site string, level string, member string, root string, seen long"
_OUT = "site string, block long, kind int, id {id}, cluster {id}, member string, root string, seen long"
_NAMES = ["site", "block", "kind", "id", "cluster", "member", "root", "seen"]


def place_key():
    """Site and level in one value that is never null; null is a value of its own."""
    return F.to_json(F.struct("site", "level"))


def empty_sets(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SETS)


class IdSets:
    """Sets of object ids of one place, each with the time its last member was seen (microseconds)."""

    def __init__(self, rows=()):
        self.of: dict[str, str] = {}
        self.members: dict[str, set[str]] = {}
        self.seen: dict[str, int] = {}
        for member, root, seen in rows:
            self.of[member] = root
            self.members.setdefault(root, set()).add(member)
            self.seen[root] = int(seen)

    def forget(self, before: int) -> None:
        for root in [r for r, t in self.seen.items() if t < before]:
            del self.seen[root]
            for member in self.members.pop(root):
                del self.of[member]

    def sight(self, ids: set[str], at: int) -> None:
        """Ids of one cluster, last seen at a time: one set from now on. A lone id without a set needs none."""
        roots = {self.of[i] for i in ids if i in self.of}
        if not roots and len(ids) < 2:
            return
        for r in roots:
            ids = ids | self.members.pop(r)
            at = max(at, self.seen.pop(r))
        root = min(ids)
        self.members[root], self.seen[root] = ids, at
        self.of.update(dict.fromkeys(ids, root))

    def rows(self):
        return [(m, r, self.seen[r]) for r, ms in self.members.items() for m in ms]


def may_meet(cameras: pd.DataFrame) -> np.ndarray:
    """Which cameras (sensor, conflicts, overlaps) may see one vehicle at a time, each with each."""
    number = {v: k for k, v in enumerate(cameras["sensor"])}
    free = np.array([v is None for v in cameras["overlaps"]], bool)  # not restricted, or on no list
    may = np.empty((len(cameras), len(cameras)), bool)
    for k, (barred, listed) in enumerate(zip(cameras["conflicts"], cameras["overlaps"])):
        may[k] = free if listed is None else False
        if listed is not None:
            may[k, [number[v] for v in listed if v in number]] = True
        may[k, [k, *(number[v] for v in (() if barred is None else barred) if v in number)]] = False
    return may


# Cameras of a block up to which it is worked out at once which of them may meet; beyond, for those of each frame.
MOST_CAMERAS = 4096


def cluster_frames_in_order(rows: pd.DataFrame, sets: IdSets, max_d: float, keep_us: int, frame_us: int):
    """(frame number, ids, their clusters) of the detections in clusters of several, frame by frame; ``sets`` is carried on.

    ``rows``: detections with frame, id, sensor, x, y, object_id, us and the cameras theirs is
    listed with (conflicts, overlaps).
    """
    rows = rows.sort_values(["frame", "id"], kind="stable")
    frame, id_, us = (rows[c].to_numpy() for c in ("frame", "id", "us"))
    x, y = (rows[c].to_numpy(float) for c in "xy")
    names = rows["object_id"].tolist()
    named = rows["object_id"].notna().to_numpy()
    able = (rows["id"].notna() & rows["sensor"].notna()).to_numpy()
    who = np.cumsum(np.r_[True, id_[1:] != id_[:-1]]) if len(rows) else np.array([], np.int64)
    camera, _ = pd.factorize(rows["sensor"], use_na_sentinel=False)
    cameras = rows[["sensor", "conflicts", "overlaps"]].iloc[np.unique(camera, return_index=True)[1]]
    may = may_meet(cameras) if len(cameras) <= MOST_CAMERAS else None
    cuts = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1], True]) if len(rows) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        number = int(frame[a])
        sets.forget(number * frame_us - keep_us)
        seen, kind = np.unique(camera[a:b], return_inverse=True)
        meet = may_meet(cameras.iloc[seen]) if may is None else may[np.ix_(seen, seen)]
        known: dict[str, list] = {}
        rooted = [(k, sets.of[names[k]]) for k in range(a, b) if named[k] and names[k] in sets.of] if sets.of else []
        for k, root in rooted:
            known.setdefault(root, []).append(k - a)
        same = [(i, j) for group in known.values() for n, i in enumerate(group) for j in group[n + 1:] if meet[kind[i], kind[j]]]
        same = np.array(same, np.int64).reshape(-1, 2).T
        label = linked_places(x[a:b], y[a:b], kind, meet, able[a:b], who[a:b], same, max_d)
        several = np.bincount(label, minlength=b - a)[label] > 1
        members: dict[int, list] = {k - a: [k] for k, _ in rooted if not several[k - a]}
        for k in np.flatnonzero(several):
            members.setdefault(int(label[k]), []).append(a + int(k))
        for group in members.values():
            sets.sight({names[k] for k in group if named[k]}, max(int(us[k]) for k in group))
        yield number, id_[a:b][several], id_[a:b][label[several]]


def cluster_known(df: DataFrame, max_d: float, conflicts: DataFrame | None = None, overlaps: DataFrame | None = None,
                  sets: DataFrame | None = None, keep_s: float = 20.0, frame_s: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cluster``, sets at the end): clusters of each frame as :func:`~spotflow.operators.tracking.cluster_frame`
    makes them, with the sets of earlier frames and those given (``sets``: site, level, member, root, seen).

    Sets at the end are those of each place's last frames, and given ones of places without rows.
    """
    id_type, frame_us, keep_us = dict(df.dtypes)["id"], int(frame_s * 1e6), int(keep_s * 1e6)
    length = max(tr.BLOCK, math.ceil(keep_s / frame_s))
    given = (sets if sets is not None else empty_sets(df)).select(place_key().alias("site"), "member", "root", "seen")
    coded = df.select(
        "id", "frame", "sensor", "object_id", "x", "y", F.unix_micros("ts").alias("us"),
        place_key().alias("site"), F.lit("").alias("level"),
    )
    seen = coded.where("frame is not null")
    for name, edges in (("conflicts", conflicts), ("overlaps", overlaps)):
        lists = None if edges is None else tr.both_directions(edges).groupBy("sensor").agg(F.collect_set("other").alias(name))
        seen = seen.withColumn(name, F.lit(None).cast("array<string>")) if lists is None else seen.join(lists, "sensor", "left")
    block = F.floor(F.col("frame") / length)
    work = cut(seen.withColumn("block", block).select(
        "site", "block", F.lit(0).alias("kind"), "frame", "id", "sensor", "x", "y", "object_id", "us", "conflicts", "overlaps"
    ))
    blocks = cut(work.select("site", "block").distinct())
    first = blocks.join(blocks.select("site", (F.col("block") + 1).alias("block")), ["site", "block"], "left_anti")
    start = cut(first.join(given, "site").select("site", "block", "member", "root", "seen"))

    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = {k: part for k, part in pdf.groupby("kind")}
        own = IdSets(kind[2][["member", "root", "seen"]].itertuples(index=False, name=None) if 2 in kind else ())
        begin = key[1] * length
        rows = kind[0].astype({"frame": "int64", "us": "int64"}) if 0 in kind else None
        if rows is None or rows["frame"].max() < begin:  # frames before a block without rows
            return pd.DataFrame([], columns=_NAMES)
        early, late = rows[rows["frame"] < begin], rows[rows["frame"] >= begin]
        for _ in cluster_frames_in_order(early, own, max_d, keep_us, frame_us):
            pass
        out = [(3, *r) for r in own.rows()] if len(early) else []
        found = [v[1:] for v in cluster_frames_in_order(late, own, max_d, keep_us, frame_us) if len(v[1])]
        out += [(1, *r) for r in own.rows()]
        state = pd.DataFrame(out, columns=["kind", "member", "root", "seen"]).assign(id=None, cluster=None)
        ids, clusters = (np.concatenate([v[n] for v in found]) if found else [] for n in (0, 1))
        pairs = pd.DataFrame({"id": ids, "cluster": clusters}).astype(object).assign(kind=0, member=None, root=None, seen=None)
        made = pd.concat([v for v in (state, pairs) if len(v)], ignore_index=True) if len(state) + len(pairs) else state
        return made.assign(site=key[0], block=key[1])[_NAMES].astype({"seen": "Int64"})

    def run(rows: DataFrame, state: DataFrame) -> DataFrame:
        group = rows.unionByName(state.withColumn("kind", F.lit(2)), allowMissingColumns=True)
        return python_groups(group, "site", "block").groupBy("site", "block").applyInPandas(follow, _OUT.format(id=id_type))

    def checksums(came: DataFrame) -> DataFrame:
        return cut(came.groupBy("site", "block").agg(F.sum(F.xxhash64("member", "root", "seen").cast("decimal(38,0)")).alias("sum")))

    ahead = F.sequence("block", F.floor((F.col("frame") + WARM) / length))
    done = cut(run(work.withColumn("block", F.explode(ahead)), start))
    used = checksums(done.where("kind = 3"))  # what came into each block
    done = done.where("kind <> 3")
    while True:
        came = done.where("kind = 1").select("site", (F.col("block") + 1).alias("block"), "member", "root", "seen").join(blocks, ["site", "block"], "left_semi")
        sums = checksums(came)
        todo = sums.join(used.withColumnRenamed("sum", "was"), ["site", "block"], "full").where(~F.col("sum").eqNullSafe(F.col("was"))).select("site", "block")
        todo = cut(todo)
        if todo.isEmpty():
            break
        again = run(work.join(todo, ["site", "block"], "left_semi"), came.join(todo, ["site", "block"], "left_semi"))
        done = cut(done.join(todo, ["site", "block"], "left_anti").select(*_NAMES).unionByName(again.select(*_NAMES)))
        used = sums
    clustered = df.join(done.where("kind = 0").select("id", "cluster"), "id", "left").select(
        *df.columns, F.coalesce("cluster", "id").alias("cluster")
    )
    last = done.groupBy("site").agg(F.max("block").alias("block"))
    ends = done.where("kind = 1").join(last, ["site", "block"], "left_semi").select("site", "member", "root", "seen")
    kept = ends.unionByName(given.join(blocks, "site", "left_anti"))
    place = F.from_json("site", "site string, level string")
    return clustered, kept.select(place.alias("p"), "member", "root", "seen").select("p.site", "p.level", "member", "root", "seen")


def live(sets: DataFrame, newest_us: int, keep_s: float = 20.0) -> DataFrame:
    """Sets seen within ``keep_s`` before a time."""
    return sets.where(F.col("seen") >= newest_us - int(keep_s * 1e6))
