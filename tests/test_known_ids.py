"""Clusters that remember ids: frame by frame in one loop, and over batches."""

import random

import pytest
from plain import dense_linkage
from pyspark.sql import functions as F

from spotflow.operators import known_ids, tracking as t


def fold(items, max_d, keep, barred):
    """The rule in one loop: {id: cluster} and the sets at the end, as {place: {frozenset: seen}}."""
    out, state = {}, {}
    for frame in sorted({r["frame"] for r in items}):
        for place in sorted({r["place"] for r in items}, key=str):
            rows = sorted((r for r in items if r["frame"] == frame and r["place"] == place), key=lambda r: r["id"])
            sets = {m: s for m, s in state.get(place, {}).items() if s >= frame * 0.5 - keep}
            pairs = []
            for i, a in enumerate(rows):
                for j in range(i + 1, len(rows)):
                    b = rows[j]
                    if a["sensor"] == b["sensor"] or frozenset((a["sensor"], b["sensor"])) in barred:
                        continue
                    d = ((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) ** 0.5
                    if any(a["oid"] in m and b["oid"] in m for m in sets):
                        d = 0.0
                    if d <= max_d:
                        pairs.append((i, j, d))
            label = dense_linkage(len(rows), pairs, max_d)
            for k in set(label):
                group = [rows[i] for i, v in enumerate(label) if v == k]
                ids, seen = frozenset(r["oid"] for r in group if r["oid"] is not None), max(r["ts"] for r in group)
                for m in [m for m in sets if m & ids]:
                    seen = max(seen, sets.pop(m))
                    ids |= m
                if len(ids) > 1:
                    sets[ids] = seen
            out.update({rows[i]["id"]: rows[k]["id"] for i, k in enumerate(label)})
            if rows:
                state[place] = sets
    return out, state


def moving(seed, n_frames=160):
    """Vehicles seen by changing cameras; now and then far from where they are, or not at all."""
    rng = random.Random(seed)
    items = []
    for v in range(9):
        x, y, start = rng.uniform(0, 300), rng.uniform(0, 60), rng.randrange(n_frames // 2)
        for f in range(start, min(n_frames, start + rng.randrange(20, 120))):
            x += rng.uniform(0, 3)
            if rng.random() < 0.25:
                continue
            for c in rng.sample(range(5), rng.choice([1, 1, 2, 3])):
                off = 80 if rng.random() < 0.1 else 0
                items.append({"frame": f, "s": f * 0.5 + rng.random() * 0.4, "x": x + off + rng.uniform(-3, 3), "y": y, "sensor": f"C{c}",
                              "oid": None if rng.random() < 0.03 else f"{c}-{v}-{f // 40}", "place": ("G", None if v % 4 == 0 else "P1")})
    rng.shuffle(items)
    for i, r in enumerate(items):
        r["id"] = f"{i:05d}"
        r["ts"] = round(r["s"] * 1e6) / 1e6
    return items


BARRED = {frozenset(("C1", "C2"))}


def prepared(rows, items):
    made = [{"s": r["s"], "x": r["x"], "y": r["y"], "sensor": r["sensor"], "object_id": r["oid"], "id": r["id"], "level": r["place"][1]} for r in items]
    return t.frames(rows(*made)).repartition(4, "id")


def sets_of(df, t0):
    out = {}
    for r in df.groupBy("site", "level", "root", "seen").agg(F.collect_set("member").alias("m")).collect():
        out.setdefault((r.site, r.level), {})[frozenset(r.m)] = round(r.seen / 1e6 - t0, 6)
    return out


@pytest.mark.parametrize("block, keep", [(2, 3.0), (64, 20.0)])
def test_clusters_are_those_of_the_loop(spark, rows, monkeypatch, block, keep):
    monkeypatch.setattr(t, "BLOCK", block)
    items = moving(block)
    edges = spark.createDataFrame([("C2", "C1")], "sensor string, other string")
    got, sets = known_ids.cluster_known(prepared(rows, items), 15, edges, keep_s=keep)
    t0 = rows({"s": 0}).select(F.unix_micros("ts")).first()[0] / 1e6
    shifted = [{**r, "frame": r["frame"] + round(t0 * 2), "ts": r["ts"] + t0} for r in items]
    want, state = fold(shifted, 15, keep, BARRED)
    assert {r.id: r.cluster for r in got.collect()} == want
    plain, _ = fold(shifted, 15, -1e18, BARRED)
    assert plain != want  # the sets do matter
    last = {p: max(r["frame"] for r in shifted if r["place"] == p) * 0.5 - keep for p in state}
    ends = {p: {m: round(s - t0, 6) for m, s in state[p].items() if s >= last[p] + keep} for p in state}
    found = sets_of(sets, t0)
    for place, want_sets in ends.items():  # sets sighted in the last frame; older ones may be kept until they are used
        assert want_sets.items() <= found.get(place, {}).items()


def test_batches_honour_earlier_sets(spark, rows):
    items = moving(5, 90)
    df = prepared(rows, items)
    edges = spark.createDataFrame([("C2", "C1")], "sensor string, other string")
    whole, _ = known_ids.cluster_known(df, 15, edges)
    middle = df.agg(F.min("frame")).first()[0] + 37
    first, sets = known_ids.cluster_known(df.where(F.col("frame") < middle), 15, edges)
    second, _ = known_ids.cluster_known(df.where(F.col("frame") >= middle), 15, edges, sets=t.cut(sets))
    parts = first.unionByName(second)
    assert sorted(map(tuple, parts.select("id", "cluster").collect())) == sorted(map(tuple, whole.select("id", "cluster").collect()))


def test_what_was_one_vehicle_stays_one(rows):
    near = t.frames(rows(*[{"s": 0.1, "x": float(k), "sensor": f"C{k}", "object_id": f"o{k}", "id": f"a{k}"} for k in (1, 2)]))
    apart = t.frames(rows(*[{"s": s, "x": 90.0 * k, "sensor": f"C{k}", "object_id": f"o{k}", "id": f"{n}{k}"}
                            for n, s in (("b", 15), ("c", 34.9), ("d", 60)) for k in (1, 2)]))
    _, sets = known_ids.cluster_known(near, 15)
    got = {r.id: r.cluster for r in known_ids.cluster_known(apart, 15, sets=t.cut(sets))[0].collect()}
    assert got == {"b1": "b1", "b2": "b1", "c1": "c1", "c2": "c1", "d1": "d1", "d2": "d2"}


def test_sets_of_silent_places_stay_until_they_are_old(spark, rows):
    df = t.frames(rows({"s": 1, "sensor": "C1"}))
    given = spark.createDataFrame([("elsewhere", None, "a", "a", 10), ("elsewhere", None, "b", "a", 10)], known_ids.SETS)
    got, sets = known_ids.cluster_known(df, 15, sets=given)
    assert got.count() == 1 and sets.count() == 2
    assert known_ids.live(sets, 20_000_010).count() == 2 and known_ids.live(sets, 20_000_011).count() == 0


def test_no_rows(rows):
    df = t.frames(rows({"s": 1})).limit(0)
    got, sets = known_ids.cluster_known(df, 15)
    assert got.count() == 0 and sets.count() == 0


def test_detections_go_to_python_and_not_their_pairs(rows, monkeypatch):
    sent, real = [], known_ids.python_groups
    monkeypatch.setattr(known_ids, "python_groups", lambda df, *keys: sent.append(df.count()) or real(df, *keys))
    df = t.frames(rows(*[{"s": 0.1, "x": k / 10, "sensor": f"C{k % 2}", "object_id": f"o{k}"} for k in range(40)]))
    got, _ = known_ids.cluster_known(df, 15)
    assert got.select("cluster").distinct().count() == 20
    assert sent[0] == 40
