"""Assignment, clusters and matching against plain sequential computation."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plain import dense_linkage, min_cost_matching
from spotflow.operators import assign, graphs, known_ids, lineage, tracking as t
from spotflow.operators.assign import best_pairing, complete_linkage
from spotflow.plans.tracking import TrackerConfig, track_batch


def test_matching_is_optimal():
    rng = np.random.default_rng(0)
    for k in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 20, (n, m)).astype(float) if k % 2 else rng.random((n, m))
        got = min_cost_matching(cost)
        assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
        c = cost if n <= m else cost.T
        best = min(sum(c[i, q[i]] for i in range(len(c))) for q in itertools.permutations(range(c.shape[1]), len(c)))
        assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_complete_linkage_does_not_chain():
    assert complete_linkage(3, [(0, 1, 1.0), (1, 2, 1.2)], 2) == [0, 0, 2]
    assert complete_linkage(3, [(0, 1, 1.5), (1, 2, 1.0), (0, 2, 2.0)], 2) == [0, 0, 0]


def test_sparse_linkage_is_the_dense_one():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(2, 25))
        p = rng.uniform(0, 12, (n, 2)).round(k % 3)  # many ties
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        barred = rng.random((n, n)) < 0.2
        pairs = [(i, j, d[i, j]) for i in range(n) for j in range(i + 1, n) if d[i, j] <= 5 and not barred[i, j]]
        assert complete_linkage(n, pairs, 5) == dense_linkage(n, pairs, 5)


def test_growing_reach_links_as_all_pairs_do(monkeypatch):
    rng = np.random.default_rng(3)
    for k in range(80):
        n, kinds = int(rng.integers(2, 160)), int(rng.integers(2, 7))
        x, y = rng.uniform(0, 30, (2, n)).round(k % 3)  # many ties
        kind, may = rng.integers(0, kinds, n), rng.random((kinds, kinds)) < 0.8
        may = may & may.T & ~np.eye(kinds, dtype=bool)
        able, who = rng.random(n) < 0.95, np.sort(rng.integers(0, 3 * n, n))
        d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
        same = np.array([(i, j) for i, j in rng.integers(0, n, (6, 2)) if i < j and may[kind[i], kind[j]]], np.int64).reshape(-1, 2)
        same = np.unique(same, axis=0).T
        near = {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)
                if d[i, j] <= 5 and may[kind[i], kind[j]] and able[i] and able[j] and who[i] != who[j]}
        near |= {(i, j): 0.0 for i, j in same.T.tolist()}
        got = assign.linked_places(x, y, kind, may, able, who, same, 5.0)
        assert got.tolist() == complete_linkage(n, [(i, j, v) for (i, j), v in near.items()], 5.0)


def test_a_crowded_frame_makes_few_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 100, (2, 3000))
    made = []
    monkeypatch.setattr(assign, "near_arrays", lambda *a, f=assign.near_arrays: (made.append(len((r := f(*a))[0])), r)[1])
    none = np.zeros((2, 0), np.int64)
    label = assign.linked_places(x, y, rng.integers(0, 5, 3000), ~np.eye(5, dtype=bool), np.ones(3000, bool), np.arange(3000), none, 20.0)
    assert sum(made) < 200_000 and len(np.unique(label)) < 1000  # of all places within reach some 900,000 are made


def test_one_frame_of_thousands():
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 2000, (2, 5000))
    pairs = [(i, j, d) for i, j, d in t.near_pairs(x, y, x, y, 15) if i < j]
    label = np.array(complete_linkage(5000, pairs, 15))
    for k in np.unique(label):
        m = np.flatnonzero(label == k)
        assert np.hypot(x[m, None] - x[m], y[m, None] - y[m]).max() <= 15
    old = {"id": list(range(5000)), "x": x, "y": y, "ids": [[]] * 5000, "conflicts": [None] * 5000}
    new = {"id": list(range(5000)), "x": x + 3, "y": y, "ids": [[]] * 5000, "sensor": ["C"] * 5000}
    found = t._assign(old, new, 20)
    assert len({a for a, _, _ in found}) == len({b for _, b, _ in found}) == len(found) == 5000
    assert sum(d * d for _, _, d in found) <= 9 * 5000 + 1e-6


def test_as_many_pairs_as_fit_then_the_nearest():
    # one row may take either; the other only the one that is nearest to both
    assert best_pairing([[(0, 1.0), (1, 399.0)], [(0, 399.0)]], 1200.0) == [(0, 1), (1, 0)]


def test_the_smaller_side_enters(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 100, (2, 260)), rng.uniform(0, 100, (2, 200))
    options = [[] for _ in range(260)]
    for i, j, d in assign.near_pairs(*a, *b, 20):
        options[i].append((j, d * d))
    pops = []
    monkeypatch.setattr(assign.heapq, "heappop", lambda heap, pop=assign.heapq.heappop: pops.append(1) or pop(heap))
    found = best_pairing(options, 261 * 400.0)
    assert len(found) == 200 and len(pops) < 2000  # 6,895 where the 260 enter
    cost = np.full((260, 200), 1e6)
    for i, row in enumerate(options):
        for j, v in row:
            cost[i, j] = v
    assert sum(cost[i, j] for i, j in found) == pytest.approx(sum(cost[i, j] for i, j in min_cost_matching(cost)))


def at(frame, x, y=0.0, **kw):
    return {"s": frame * 0.5 + 0.1, "x": float(x), "y": float(y), **kw}


def fold(items, max_d, carry, barred=frozenset()):
    """The rule as a loop over frames: (prev, cur) pairs."""
    by = {}
    for it in items:
        by.setdefault(it["frame"], []).append(it)
    prev, pairs = [], set()
    for f in sorted(by):
        new = sorted(by[f], key=lambda r: (r["ts"], r["id"]))
        used = set()
        if prev:
            d = np.array([[np.hypot(a["x"] - b["x"], a["y"] - b["y"]) for b in new] for a in prev])
            cost = np.array([[0.0 if a["oid"] == b["oid"] else v for b, v in zip(new, row)] for a, row in zip(prev, d)])
            top = max_d * (1 + len(prev)) ** 0.5  # alone: dearer than all pairs
            for i, a in enumerate(prev):
                for j, b in enumerate(new):
                    if cost[i, j] > max_d or frozenset((a["sensor"], b["sensor"])) in barred:
                        cost[i, j] = top
            for i, j in min_cost_matching(cost**2):
                if cost[i, j] <= max_d:
                    pairs.add((prev[i]["id"], new[j]["id"]))
                    used.add(prev[i]["id"])
        now = min(r["ts"] for r in new)
        prev = [r for r in prev if r["id"] not in used and now - r["ts"] <= carry] + new
        prev.sort(key=lambda r: (r["ts"], r["id"]))
    return pairs


@pytest.mark.parametrize("block", [2, 64])
def test_match_frames_equals_the_loop(spark, rows, monkeypatch, block):
    monkeypatch.setattr(t, "BLOCK", block)
    rng = random.Random(block)
    items, n = [], 0
    for f in range(30):
        if f % 11 == 5:
            continue
        for _ in range(rng.randrange(1, 5)):
            s = f * 0.5 + rng.random() * 0.49
            items.append({"s": s, "x": rng.uniform(0, 60), "y": rng.uniform(0, 10), "id": f"{n:04d}",
                          "object_id": f"o{rng.randrange(40)}", "sensor": f"C{rng.randrange(4)}"})
            n += 1
    df = t.frames(rows(*items)).repartition(4, "id")
    edges = spark.createDataFrame([("C1", "C2")], "sensor string, other string")
    got = {(r.prev_id, r.id) for r in t.match_frames(df, 20, 3.0, 0.5, edges).collect()}
    plain = [{"id": i["id"], "frame": int(round(i["s"] * 1e6)) // 500_000, "ts": round(i["s"] * 1e6) / 1e6, "x": i["x"],
              "y": i["y"], "oid": i["object_id"], "sensor": i["sensor"]} for i in items]
    assert got == fold(plain, 20, 3.0, {frozenset(("C1", "C2"))})


def test_places_enough_for_the_cores_are_followed_at_once(spark, rows, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 4)
    rng = random.Random(5)
    items = [{"frame": f, "s": f * 0.5 + rng.random() * 0.49, "x": rng.uniform(0, 40), "y": rng.uniform(0, 10), "id": f"{n:04d}",
              "object_id": f"o{n}", "site": f"G{n % 4}"} for n, f in enumerate(sorted(rng.randrange(30) for _ in range(400)))]
    df = t.frames(rows(*[{k: v for k, v in i.items() if k != "frame"} for i in items])).repartition(4, "id")
    cuts = []
    monkeypatch.setattr(t, "cut", lambda df: cuts.append(1) or lineage.cut(df))
    found = t.match_frames(df, 20, 3.0, 0.5)
    assert len(cuts) == 3  # the frames, the rows and the pairs: no block is guessed and done again
    got = {(r.prev_id, r.id) for r in found.collect()}
    want = set()
    for k in range(4):
        want |= fold([{**i, "ts": round(i["s"] * 1e6) / 1e6, "oid": i["object_id"], "sensor": "C1"} for i in items if i["site"] == f"G{k}"], 20, 3.0)
    assert got == want


def test_pairs_stand_from_the_frame_that_finds_the_same_rows_open(monkeypatch):
    calls = []
    monkeypatch.setattr(t, "_assign", lambda *a, f=t._assign: calls.append(1) or f(*a))
    base = pd.DataFrame({"id": range(10, 30), "no": [n // 2 for n in range(20)], "x": [0.0, 50.0] * 10, "y": 0.0, "sensor": "C", "carried": False})
    base = base.assign(us=base["no"] * 500_000, since=(base["no"] - 1) * 500_000, ids=[[n] for n in range(20)], conflicts=None)
    base = base.iloc[:19]  # one row is missing in the last frame
    first, _ = t._assign_block(base, 0, 20.0, 3_000_000, 8)
    assert len(first) == 17 and len(calls) == 9
    # A row before the first frame was taken for gone and is not: it differs until it is too old or is paired.
    late = base.iloc[:1].assign(id=5, no=-1, us=-500_000, x=900.0, carried=True, ids=[[99]])
    had = pd.DataFrame(first, columns=["no", "mate", "id", "apart"])
    now = pd.concat([base.assign(met=False, was=False, mate=base["id"]), late.assign(met=False, was=True, mate=5),
                     had.assign(met=True, was=False, carried=False, us=0)], ignore_index=True)
    again, _ = t._assign_block(now, 0, 20.0, 3_000_000, 8)
    assert sorted(again) == sorted(first) and 9 < len(calls) < 18


def test_crossing_vehicles_are_matched_together(rows):
    # Greedy would join 0001 with 0002 (distance 1) and leave 19 for the rest.
    df = t.frames(rows(at(0, 0, object_id="a"), at(0, 10, object_id="b"), at(1, 9, object_id="c"), at(1, 18, object_id="d")))
    pairs = {(r.prev_id, r.id) for r in t.match_frames(df, 20, 3.0).collect()}
    assert pairs == {("0000", "0002"), ("0001", "0003")}


@pytest.mark.parametrize("gap_frames, matched", [(6, True), (8, False)])
def test_carried_three_seconds(rows, gap_frames, matched):
    # Frames with another vehicle far away lie between.
    far = [at(f, 500, object_id=f"f{f}") for f in range(1, gap_frames + 1)]
    df = t.frames(rows(at(0, 0, object_id="a"), *far, at(gap_frames + 1, 1, object_id="b")))
    pairs = {(r.prev_id, r.id) for r in t.match_frames(df, 20, 3.0).collect()}
    assert (("0000", f"{gap_frames + 1:04d}") in pairs) == matched


def test_common_id_matches_at_any_distance(rows):
    df = t.frames(rows(at(0, 0, object_id="a"), at(1, 400, object_id="a")))
    assert t.match_frames(df, 20, 3.0).count() == 1


def test_cluster_needs_other_compatible_cameras(rows, spark):
    df = t.frames(rows(
        at(0, 0, sensor="C1", object_id="a"), at(0, 1, sensor="C1", object_id="b"),
        at(2, 0, sensor="C1", object_id="a"), at(2, 1, sensor="C2", object_id="b"),
        at(4, 0, sensor="C1", object_id="a"), at(4, 1, sensor="C3", object_id="b"),
        at(6, 0, sensor="C1", object_id="a"), at(6, 10, sensor="C2", object_id="b"), at(6, 19, sensor="C4", object_id="c"),
    ))
    bars = spark.createDataFrame([("C3", "C1")], "sensor string, other string")
    got = {r.id: r.cluster for r in t.cluster_frame(df, 15, bars).collect()}
    assert got["0001"] == "0001" and got["0003"] == "0002" and got["0005"] == "0005"
    assert got["0007"] == "0007" and got["0008"] == "0007" and got["0006"] == "0006"  # 9 m before 10 m


def test_known_ids_cluster_at_any_distance(rows, spark):
    df = t.frames(rows(at(0, 0, sensor="C1", object_id="a"), at(0, 90, sensor="C2", object_id="b")))
    same = spark.createDataFrame([("a", "a"), ("b", "a")], "member string, root string")
    assert {r.cluster for r in t.cluster_frame(df, 15, same=same).collect()} == {"0000"}


def test_components_and_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    roots = {r.member: r.root for r in graphs.connected_components(pairs).collect()}
    assert all(roots[i] == 1 for i in range(1, 41)) and roots[101] == 100
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "prev_id long, id long")
    heads = {r.id: r.head for r in graphs.chain_heads(links, spark.range(1, 23)).collect()}
    assert heads[20] == 1 and heads[21] == 21


def test_plates_follow_the_vehicle(rows):
    cfg = TrackerConfig()
    df = rows(
        at(0, 0, license="", object_id="a"), at(1, 2, license="", object_id="b"), at(2, 4, license="Q7", object_id="c"),
        at(3, 6, license="", object_id="d"), at(4, 8, license="Q7", object_id="e"), at(3, 300, license="", object_id="z"),
        {"s": 1, "type": "parked", "spot": "PS-1", "license": "", "object_id": "p"},
    )
    out = {r.id: r for r in track_batch(df.repartition(3), cfg=cfg).rows.collect()}
    assert [out[f"000{i}"].license for i in range(5)] == ["UNK-M-0", "UNK-M-0", "Q7", "Q7", "Q7"]
    assert [out[f"000{i}"].object_id for i in (0, 1, 2, 3, 4)] == ["^SC1_^Oa"] * 2 + ["^SC1_^Oc"] * 3
    assert out["0005"].license == "UNK-M-1" and out["0006"].track_id is None
    assert out["0001"].heading == 0.0 and {out[f"000{i}"].track_id for i in range(5)} == {"0000"}


def test_departed_vehicle_is_the_first_parked(rows):
    steps = [(0, "parked", "A"), (10, "parked", "B"), (20, "empty", ""), (30, "empty", ""), (40, "parked", "C"), (50, "empty", "")]
    df = rows(*[{"s": s, "type": k, "license": v, "spot": "PS-1"} for s, k, v in steps])
    got = [(r.id, r.license) for r in t.departed_vehicle(df).orderBy("id").collect()]
    assert got == [("0002", "A"), ("0005", "C")]


def sizes_sent(module, monkeypatch):
    """Rows of each call that goes to Python."""
    sent, real = [], module.python_groups
    monkeypatch.setattr(module, "python_groups", lambda df, *keys: sent.append(df.count()) or real(df, *keys))
    return sent


def test_rows_go_to_their_block_and_not_to_every_frame_in_reach(rows, monkeypatch):
    sent = sizes_sent(t, monkeypatch)
    df = t.frames(rows(*[at(f, f, object_id=f"o{f}") for f in range(40)]))
    assert t.match_frames(df, 20, 3.0).count() == 39
    assert max(sent) == 40


def test_pairing_reads_few_options_where_all_are_allowed():
    class Cost(float):
        read = 0

        def __radd__(self, other):
            Cost.read += 1
            return other + float(self)

    rng = np.random.default_rng(3)
    cost = rng.random((60, 60))
    found = best_pairing([[(j, Cost(c)) for j, c in enumerate(row)] for row in cost], 100.0)
    least = sum(cost[i, j] for i, j in min_cost_matching(cost))
    assert sum(cost[i, j] for i, j in found) == pytest.approx(least) and len(found) == 60
    assert Cost.read < 60 * 60


def test_mutual_nearest_folds_by_hash(spark, capsys):
    rng = random.Random(3)
    made = [(0, 0, rng.randrange(30), rng.randrange(30), float(rng.randrange(4))) for _ in range(300)]
    made += [(0, 1, 3, 4, 9.0), (0, 0, None, 31, 1.0), (0, 0, 31, 31, 1.0), (0, 0, 32, None, 1.0), (0, 0, 32, 32, 1.0)]  # null comes first
    pairs = spark.createDataFrame(made, "site int, frame long, id1 long, id2 long, cost double")

    def least(rows, own, other):
        rows = sorted(rows, key=lambda r: (r[4], r[other] is not None, r[other] or 0), reverse=True)
        return {r[own]: r[other] for r in rows}

    ahead, back = least(made, 2, 3), least(made, 3, 2)
    want = [r for r in made if None not in r and ahead[r[2]] == r[3] and back[r[3]] == r[2]]
    found = t.match_mutual_nearest(pairs)
    assert sorted(map(tuple, found.select(*pairs.columns).collect())) == sorted(want) != []
    found.explain()
    assert "SortAggregate" not in capsys.readouterr().out  # it sorts all pairs


def test_mutual_nearest_of_made_candidates(rows):
    rng = random.Random(4)
    seen = rows(*[{"s": 10.0 * (i % 6), "x": float(rng.randrange(12)), "y": float(rng.randrange(12)), "object_id": f"o{rng.randrange(40)}",
                   "id": f"{i % 110:04d}"} for i in range(120)])  # ties, common ids and repeated ids
    made = t.frame_to_frame_candidates(t.frames(seen, 10), 5.0)
    again = lambda **more: t.frame_to_frame_candidates(t.frames(seen, 10), 5.0, **more)
    found, want = t.match_mutual_nearest(made, again), t.match_mutual_nearest(made)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
