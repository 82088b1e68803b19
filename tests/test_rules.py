"""Boundary rows of the rules, small enough to check by eye."""

import pytest
from pyspark.sql import functions as F

from spotflow.functions import columns as c
from spotflow.operators import anomaly, quality, regions, tracks
from spotflow.operators import projections as p


def park(s, type_, spot="PS-1", **kw):
    return {"s": s, "type": type_, "spot": spot, **kw}


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


# -- overstay ----------------------------------------------------------------------


def test_overstay_needs_more_than_the_threshold(rows):
    df = rows(park(0, "parked"), park(300, "empty"), park(1000, "parked", spot="PS-2"), park(1300.001, "empty", spot="PS-2"))
    assert ids(anomaly.overstay(df)) == ["0002"]


def test_overstay_only_the_row_before_empty(rows):
    df = rows(park(0, "parked"), park(1000, "parked"), park(2000, "empty"), park(3000, "parked"))
    assert ids(anomaly.overstay(df)) == ["0001"]
    now = F.lit("2024-01-01 14:00:00").cast("timestamp")
    assert ids(anomaly.overstay(df, include_open=True, now=now)) == ["0001", "0003"]


def test_overstay_keeps_sites_apart(rows):
    df = rows(park(0, "parked"), park(500, "empty", site="H"), park(1000, "empty"))
    found = anomaly.overstay(df).select("id", "hours").collect()
    assert [(r.id, round(r.hours, 4)) for r in found] == [("0000", round(1000 / 3600, 4))]


def test_overstay_text(rows):
    df = p.build_overstay(anomaly.overstay(rows(park(0, "parked"), park(5400, "empty", video="v"))))
    r = df.first()
    assert r.analyticsModule.description == "Overstay, 1.5 hrs" and r.exitVideo == "v" and r.entryVideo == ""


# -- understay ------------------------------------------------------------------------


def stay(*steps, **kw):
    return [{"s": s, "type": t, **kw} for s, t in steps]


@pytest.mark.parametrize(
    "steps, expected",
    [
        ([(0, "entry"), (0, "exit")], []),
        ([(0, "entry"), (10, "exit")], [("0000", "0001")]),
        ([(10, "exit")], []),
        ([(0, "entry"), (100, "entry"), (150, "exit")], [("0001", "0002")]),
        ([(0, "entry"), (300, "exit")], []),
        ([(0, "entry"), (299.999, "exit")], [("0000", "0001")]),
        ([(0, "entry"), (10, "exit"), (12, "exit")], [("0000", "0001")]),
    ],
)
def test_understay(rows, steps, expected):
    found = anomaly.understay(rows(*stay(*steps)))
    assert [(r.entry_id, r.exit_id) for r in found.collect()] == expected


def test_understay_ignores_unidentified(rows):
    df = rows(*[{"s": s, "type": t, "license": v} for v in (" unknown", "", None, "dgdgcom") for s, t in ((0, "entry"), (9, "exit"))])
    assert anomaly.understay(df).count() == 0


# -- lists --------------------------------------------------------------------------------


def test_white_wins_and_case_counts(rows, spark):
    white = spark.createDataFrame([("A1",)], "license string")
    black = spark.createDataFrame([("A1",), ("B2",)], "license string")
    df = rows(*[{"s": i, "type": t, "license": v} for i, (t, v) in enumerate(
        [("entry", "A1"), ("exit", "B2"), ("entry", "b2"), ("moving", "B2")])])
    found = anomaly.list_anomaly(df, white, black)
    assert sorted((r.id, r.list) for r in found.collect()) == [("0000", "Whitelist"), ("0001", "Blacklist")]


# -- stops ------------------------------------------------------------------------------------


def move(s, x=0.0, y=0.0, **kw):
    return {"s": s, "x": float(x), "y": float(y), **kw}


@pytest.mark.parametrize(
    "points, found",
    [
        ([(0, 0), (20, 0)], 1),
        ([(0, 0), (19.999, 0)], 0),
        ([(0, 0), (20, 4.0)], 1),  # a new stop may span exactly 4 m
        ([(0, 0), (20, 4.001)], 0),
        ([(0, 0)], 0),
    ],
)
def test_stalled_window(rows, points, found):
    df = rows(*[move(s, x) for s, x in points])
    assert anomaly.stalled_windows(df).count() == found
    assert anomaly.stalled_episodes(df).count() == found


def test_episode_goes_on_while_it_stays(rows):
    df = rows(move(0), move(25), move(40, 3.9), move(70, 1, video="v"))
    found = anomaly.stalled_episodes(df).orderBy("end_ts").collect()
    assert [(r.end_ts - r.start_ts).total_seconds() for r in found] == [25, 40, 70]
    assert found[-1].video == ""


def test_episodes_over_many_gaps_are_those_of_one_fold(rows, monkeypatch):
    """Runs between gaps, each followed alone, against all windows of a plate in turn; in many small groups."""
    import random

    rng = random.Random(11)
    monkeypatch.setattr(anomaly, "STRETCH", 4)
    at, points = 0.0, []
    for _ in range(400):
        at += rng.choice([5, 12, 25, 25, 31, 45, 70, 130])
        points.append(move(at, rng.choice([0, 0, 0, 1, 9]), type=rng.choice(["moving"] * 9 + ["entry"])))
    df = rows(*points)
    state, want = None, []
    for w in sorted(anomaly.window_summaries(df, 30).collect(), key=lambda r: r.window_start):
        state, hit = anomaly.advance_stop(state, anomaly.summary_facts(w), 4.0, 20.0, 60.0)
        if hit:
            want.append((w.window_start, hit["ms"], hit["end_ms"], hit["video"]))
    got = anomaly.stalled_episodes(df, 30, 4.0, 20.0, 60.0).select(
        "window_start", F.unix_millis("start_ts"), F.unix_millis("end_ts"), "video").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_episode_of_exactly_four_metres_has_moved(rows):
    df = rows(move(0), move(25), move(40, 4.0))
    assert anomaly.stalled_episodes(df).count() == 1


def test_moved_and_back_to_the_anchor(rows):
    df = rows(move(0), move(25), move(40, 50), move(70, 1))
    found = anomaly.stalled_episodes(df).orderBy("end_ts").collect()
    assert [(r.end_ts - r.start_ts).total_seconds() for r in found] == [25, 70]


def test_silence_ends_a_stop(rows):
    near = rows(move(0), move(25), move(325), move(326))
    assert [(r.end_ts - r.start_ts).total_seconds() for r in anomaly.stalled_episodes(near).collect()] == [25, 326]
    far = rows(move(0), move(25), move(326), move(328))
    assert anomaly.stalled_episodes(far).count() == 1


def test_row_after_move_and_silence_only_ends_the_state(rows):
    df = rows(move(0), move(25), move(40, 50), move(400, 50), move(421, 50), move(450, 50), move(471, 50))
    found = anomaly.stalled_episodes(df).orderBy("start_ts").collect()
    assert [(r.end_ts - r.start_ts).total_seconds() for r in found] == [25, 50]  # from 421, not from 400


def test_entry_clears_the_video(rows):
    df = rows(move(0, type="entry", video="a"), move(21, video="b"))
    assert anomaly.stalled_windows(df).first().video == ""
    assert p.build_stalled(anomaly.stalled_windows(df)).first().analyticsModule.description == "Unexpected Stopping 21.0 seconds"


# -- tracks ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("last, kept", [(3.0, 0), (3.001, 2)])
def test_track_must_be_longer_than_three_seconds(rows, last, kept):
    assert tracks.valid_tracks(rows(move(0), move(last))).count() == kept


@pytest.mark.parametrize("gap, starts", [(5.999, 1), (6.0, 2)])
def test_gap_splits(rows, gap, starts):
    df = tracks.track_sessions(rows(move(0), move(gap)), ["sensor", "object_id"])
    assert df.select("track_start").distinct().count() == starts


@pytest.mark.parametrize("n, out", [(99, 99), (100, 98)])
def test_smoothing_threshold(rows, n, out):
    df = rows(*[move(i, i, i % 7) for i in range(n)])
    points = tracks.smooth_track(df, ["object_id"]).orderBy("seq").collect()
    assert [r.seq for r in points] == list(range(out))
    assert (points[0].x, points[-1].x) == (0, n - 1)
    if n == 100:
        assert points[1].x == 2.0 and points[-2].x == 97.0


def test_speed_uses_whole_seconds(rows):
    df = rows(move(0), move(1.9, 3, 4))
    r = tracks.track_summary(df, ["object_id"]).first()
    assert (r.distance, r.linear_distance, r.duration, r.speed) == (5.0, 5.0, 1.9, 18.0)
    one = tracks.track_summary(rows(move(0, 1, 1)), ["object_id"]).first()
    assert (one.distance, one.duration, one.speed) == (0.0, 0.0, 0.0)


def test_heading_kept_while_standing(rows):
    df = tracks.heading(rows(move(0), move(1, 1, 0), move(2, 1, 0), move(3, 1, -1)), ["object_id"])
    assert [r.heading for r in df.orderBy("ts").collect()] == [None, 0.0, 0.0, 270.0]


# -- regions ----------------------------------------------------------------------------------------


def test_only_strictly_inside_is_ignored(rows, spark):
    square = spark.createDataFrame([("C1", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])],
                                   "sensor string, ring array<struct<x: double, y: double>>")
    df = rows(move(0, 5, 5), move(1, 0, 5), move(2, 10, 10), move(3, 5, 5, sensor="C2"),
              move(4, 5, 5, type="parked", spot="S"), move(5, 11, 5))
    kept, gone = regions.outside_ignore_regions(df, square)
    assert ids(gone) == ["0000"] and kept.count() == 5


def test_nearest_node_is_exact(spark):
    import math
    import random

    rng = random.Random(3)
    pts = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(80)] + [(999, 5000.0, 1.0)]
    nodes = [(f"n{i}", rng.uniform(0, 20), rng.uniform(0, 100)) for i in range(30)]
    got = regions.nearest_node(spark.createDataFrame(pts, "id long, x double, y double"),
                               spark.createDataFrame(nodes, "node_id string, x double, y double"))
    want = {i: min((math.hypot(x - a, y - b), n) for n, a, b in nodes)[1] for i, x, y in pts}
    assert {r.id: r.node_id for r in got.collect()} == want


def test_nearest_node_far_points_and_dense_nodes(spark):
    import math
    import random

    rng = random.Random(5)
    dense = [(f"c{i}", 50 + rng.random() / 1000, 50 + rng.random() / 1000) for i in range(1500)]
    loose = [(f"l{i}", rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4)) for i in range(40)]
    nodes = dense + loose + [("same", *dense[0][1:]), ("a_null", None, 1.0), ("a_nan", float("nan"), 1.0)]
    pts = [(i, 50 + rng.random() / 1000, 50 + rng.random() / 1000) for i in range(60)]
    pts += [(100 + i, rng.uniform(-2e4, 2e4), rng.uniform(-2e4, 2e4)) for i in range(60)]
    pts += [(200, 1e12, -1e12), (201, 50.0, 51.0), (202, 50.0, 51.0), (203, None, 1.0), (204, float("nan"), 1.0)]
    kind = "node_id string, x double, y double"
    points = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r for r in regions.nearest_node(points, spark.createDataFrame(nodes, kind)).collect()}
    assert len(got) == len(pts)
    for i, x, y in pts:
        if i in (203, 204):
            assert got[i].node_id is None and got[i].distance is None
        else:
            d = min(math.hypot(x - a, y - b) for n, a, b in nodes[:-2])
            assert math.isclose(got[i].distance, d, rel_tol=1e-9), i
    empty = regions.nearest_node(points, spark.createDataFrame([("n", None, 1.0)], kind))
    assert [r.node_id for r in empty.collect()] == [None] * len(pts)
    one = regions.nearest_node(points.where("id < 3"), spark.createDataFrame([("n", 1.0, 1.0)], kind))
    assert [r.node_id for r in one.collect()] == ["n"] * 3


# -- quality ---------------------------------------------------------------------------------------------

GOOD = '{"event":{"type":"entry"},"place":{"name":"a"},"@timestamp":"x","object":{"vehicle":{}}}'


@pytest.mark.parametrize(
    "text, message",
    [
        (GOOD, ""),
        ("{broken", "not a JSON object"),
        ("[1]", "not a JSON object"),
        (GOOD.replace('"event":{"type":"entry"},', ""), "event: missing"),
        (GOOD.replace("entry", "flying"), "event.type: not one of the known values"),
        (GOOD.replace('{"vehicle":{}}', "{}"), "object.vehicle: missing"),
        (GOOD.replace('"vehicle":{}', '"vehicle":null'), "object.vehicle: not of type object"),
        (GOOD.replace('"a"', "7"), "place.name: not of type string/null"),
        (GOOD.replace('"a"', "null"), ""),
        (GOOD.replace('"x"', "null"), "@timestamp: not of type string"),
        (GOOD.replace('"vehicle":{}', '"vehicle":{},"signature":[1, 2.5]'), ""),
        (GOOD.replace('"vehicle":{}', '"vehicle":{},"signature":["a"]'), "object.signature: items not number/null"),
    ],
)
def test_validation(spark, text, message):
    r = quality.validate_events(spark.createDataFrame([(text,)], "value string")).first()
    assert (r.flag, r.message) == (message == "", message)


def test_repair_and_parse(spark):
    text = GOOD.replace('{"event"', '{"used" : "1","event"')
    r = p.parse_events(spark.createDataFrame([(text,), ("junk",)], "value string")).select("event.type", "timestamp").collect()
    assert [x.type for x in r] == ["entry", None]


def test_plate_cipher_round_trip(spark):
    key, iv = "k" * 32, "i" * 16
    df = spark.createDataFrame([("ABC123",), ("  ",), (None,)], "license string")
    out = df.select("license", p.encrypt_plate("license", key, iv).alias("e")).select(
        "license", "e", p.decrypt_plate("e", key, iv).alias("d")).collect()
    assert [r.d for r in out] == [r.license for r in out]
    assert out[0].e != "ABC123" and len(out[0].e) == 24 and out[1].e == "  "


@pytest.mark.parametrize("value, text", [(2.675, "2.68"), (0.125, "0.13"), (1.0, "1.0"), (2.004, "2.0")])
def test_half_up(spark, value, text):
    assert spark.range(1).select(c.two_places(F.lit(value)).alias("t")).first().t == text


# -- roads ---------------------------------------------------------------------------------------------


def test_roads_from_lines_to_positions(spark, monkeypatch):
    from spotflow.operators import roads

    lines = spark.createDataFrame(
        [("a", [(0.0, 0.0), (10.0, 0.0), (10.0, 7.0)]), ("b", [(10.0, 7.02), (0.0, 7.0)])],
        "line_id string, points array<struct<x: double, y: double>>")
    dense = roads.densify(roads.segments(lines), 3.0)
    first = dense.where("line_id = 'a' and segment = 0").orderBy("pos").collect()
    assert [round(r.x, 6) for r in first] == [0, 3, 6, 9, 10]
    drawn_back = dense.where("line_id = 'b'").orderBy("pos").collect()
    assert [round(r.x) for r in drawn_back] == [10, 9, 6, 3, 0]
    nodes = roads.build_nodes(dense)
    edges = roads.cut(roads.build_edges(dense, nodes))
    assert nodes.count() == 5 + 3 + 4  # the lines share the corner (10, 7)
    source = nodes.where("x = 0 and y = 0").select("node_id")
    found = roads.cut(roads.shortest_paths(edges, source))
    end = nodes.where("x = 0 and y = 7").select(F.col("node_id").alias("target"))
    path = roads.paths_to(found, source.select(F.col("node_id").alias("source")).crossJoin(end)).orderBy("seq").collect()
    assert path[0].distance == 0 and round(path[-1].distance, 1) == 27.0 and len(path) == 12
    monkeypatch.setattr(roads, "LEGS", 2)
    points = spark.createDataFrame([("p", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (4.0, 0.0), (4.0, 6.0)])],
                                   "path_id string, seq long, x double, y double")
    times = spark.sql("select 'p' as path_id, timestamp '2024-01-01 00:00:00' as t0, timestamp '2024-01-01 00:00:02.2' as t1")
    out = roads.interpolate_path(points, times, 0.5).orderBy("ts").collect()
    want = [(min(s, 4.0), max(0.0, s - 4)) for s in (10 * t / 2.2 for t in (0, 0.5, 1, 1.5, 2, 2.2))]
    assert [(round(r.x, 6), round(r.y, 6)) for r in out] == [(round(a, 6), round(b, 6)) for a, b in want]


def test_points_snap_to_the_nearest_of_all_lines(spark):
    import math
    import random

    from spotflow.operators import regions

    rng = random.Random(5)
    lines = [(f"L{i:03d}", *(rng.uniform(-60, 60) for _ in range(4))) for i in range(120)]
    lines += [(f"K{i}", *lines[3][1:]) for i in range(40)] + [("dot", 3.0, 4.0, 3.0, 4.0), ("far", -4000.0, 1.0, 4000.0, 9.0), ("none", None, 1.0, 2.0, 3.0)]
    points = [(i, round(rng.uniform(-70, 70), 1), float(rng.randint(-70, 70))) for i in range(400)] + [(400, None, 1.0), (401, 900.0, 900.0)]
    found = regions.snap_to_roads(
        spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(lines, "line_id string, x1 double, y1 double, x2 double, y2 double"), 5.0)
    want = {}
    for i, x, y in points:
        best = (math.inf, None)
        for name, x1, y1, x2, y2 in lines if x is not None else ():
            if x1 is not None:
                dx, dy = x2 - x1, y2 - y1
                t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                best = min(best, (round(math.hypot(x - x1 - t * dx, y - y1 - t * dy), 9), name))
        want[i] = best if best[0] <= 5 else (None, None)
    got = {r.id: (None if r.snap_distance is None else round(r.snap_distance, 9), r.line_id) for r in found.collect()}
    assert got == want and sum(d is not None for d, _ in want.values()) > 200
    # pairs of places and lines are folded as they stream by, never sorted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_min(d#" in plan


def test_cells_of_all_lines_are_not_sent_to_the_driver(spark):
    # 300 lines are small enough to send; the cells around their steps, some thousand times as many, need not be
    lines = spark.range(300).selectExpr("id % 150 as line_id", "id * 1.0 as x1", "0.0 as y1", "id * 1.0 + 2000 as x2", "900.0 as y2")
    points = spark.range(400).selectExpr("id", "id * 5.0 as x", "id * 2.0 as y")
    found = regions.snap_to_roads(points, lines, 5.0)
    assert len(found.collect()) == 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [row for row in plan.split("== Initial Plan ==")[0].splitlines() if "Join [_ux" in row]
    assert len(joins) >= 2 and all("ShuffledHashJoin" in row for row in joins)
