"""Streams give the batch answer; sinks survive a repeated batch."""

import random

import pytest
from pyspark.sql import functions as F

from spotflow.operators import anomaly, flow, occupancy, projections as p, scene, tracks
from spotflow.plans.tracking import TrackerConfig, track_batch
from spotflow.sources import adapter, readers, writers
from spotflow.streaming import jobs, state
from spotflow.streaming.tracker import StreamTracker, start_tracker


@pytest.fixture
def stream(spark, tmp_path):
    """Write detections as files in time order (one per micro-batch) and read them as a stream."""

    def make(df, parts=3):
        path = str(tmp_path / "in")
        all_rows = df.orderBy("ts", "id").collect()
        size = -(-len(all_rows) // parts)
        for i in range(0, len(all_rows), size):
            spark.createDataFrame(all_rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


@pytest.fixture
def run(tmp_path):
    return jobs.StreamRun(str(tmp_path / "ckpt"), str(tmp_path / "out"), drain=True)


def traffic(n=120, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        plate = f"A{rng.randrange(5)}"
        out.append({"s": round(rng.uniform(0, 900), 3), "type": rng.choice(["entry", "exit", "moving", "parked", "empty"]),
                    "license": plate, "object_id": plate, "x": rng.choice([0.0, 1.0, 2.0, 30.0]), "y": 0.0,
                    "spot": f"PS-{rng.randrange(3)}", "video": rng.choice(["", "v"])})
    return out


END = {"s": 100_000, "type": "exit", "license": "ZZ", "object_id": "zz"}  # lets every window and timer close


def table(df, *cols):
    return sorted(tuple(map(str, r)) for r in df.select(*cols).collect())


def test_flow_stream(spark, rows, stream, run):
    df = rows(*traffic(), END)
    jobs.await_all(spark, jobs.start_flow(run, stream(df), 60, 10))
    got = writers.read_flow_rate(spark, f"{run.tables}/flow_rate")
    want = flow.flow_table(flow.flow_rate(df, 60, 10)).where(F.col("timestamp") < "2024-01-02")
    assert table(got, "id", "timestamp", "entry", "exit") == table(want, "id", "timestamp", "entry", "exit") != []


def test_flow_rate_is_per_hour(rows):
    df = flow.flow_rate(rows({"s": 0, "type": "entry"}, {"s": 5, "type": "entry"}), 60, 10)
    out = df.orderBy("timestamp").collect()
    assert len(out) == 6 and {r["count"] for r in out} == {120}
    assert str(out[0].timestamp)[11:] == "12:00:10" and str(out[-1].timestamp)[11:] == "12:01:00"
    odd = flow.flow_rate(rows({"s": 0, "type": "entry"}), 60, 25)
    assert {r["count"] for r in odd.collect()} == {60}


def test_understay_stream(spark, rows, stream, run):
    df = rows(*traffic(), END)
    jobs.await_all(spark, run.start(state.understay_stream(stream(df), 120), "found"))
    got = spark.read.parquet(f"{run.tables}/found")
    cols = ("plate", "entry_id", "exit_id", "start_ts", "end_ts", "entry_video", "exit_video")
    assert table(got, *cols) == table(anomaly.understay(df, 120), *cols) != []


def test_understay_sink(spark, rows, stream, run):
    df = rows({"s": 0, "type": "entry"}, {"s": 60, "type": "exit"}, END)
    jobs.await_all(spark, jobs.start_understay(run, stream(df, 1)))
    got = spark.read.parquet(f"{run.tables}/understay").select("key", F.get_json_object("value", "$.analyticsModule.description")).collect()
    assert [tuple(r) for r in got] == [("Understay", "Short Stay 1.0 minutes")]


def test_stalled_stream(spark, rows, stream, run):
    df = rows(*traffic(300), END)
    jobs.await_all(spark, run.start(state.stalled_stream(stream(df), 30, 4.0, 20.0, 60.0), "found"))
    got = spark.read.parquet(f"{run.tables}/found")
    cols = ("plate", "window_start", "start_ts", "end_ts", "video", "site")
    assert table(got, *cols) == table(anomaly.stalled_episodes(df, 30, 4.0, 20.0, 60.0), *cols) != []


def test_valid_tracks_stream(spark, rows, stream, run):
    df = rows(*traffic(300), END)
    jobs.await_all(spark, run.start(state.valid_tracks_stream(stream(df), ["license"], 12, 5), "found"))
    got = spark.read.parquet(f"{run.tables}/found")
    want = tracks.valid_tracks(df, ["license"], 12, 5)
    assert table(got, "license", "id", "track_start") == table(want, "license", "id", "track_start") != []


def test_scene_stream_retires_idle_vehicles(spark, rows, stream, run):
    df = rows({"s": 0}, {"s": 4}, {"s": 20}, {"s": 22, "type": "exit"}, END)
    jobs.await_all(spark, jobs.start_scene(run, stream(df), 5))
    got = spark.read.parquet(f"{run.tables}/scene").where("object_id = 'o1'")
    assert table(got, "id", "removed") == [("0000", "0"), ("0001", "0"), ("0001", "1"), ("0002", "0"), ("0003", "1")]


def test_state_is_kept_in_rocksdb_over_a_restart(spark, rows, tmp_path):
    """Each run takes one file more; the rows of all runs are those of one."""
    df = rows(*traffic(200), END)
    all_rows = df.orderBy("ts", "id").collect()
    source = str(tmp_path / "in")
    runs = {
        "understay": (lambda d: state.understay_stream(d, 120), lambda d: anomaly.understay(d, 120), ("plate", "entry_id", "exit_id")),
        "tracks": (lambda d: state.valid_tracks_stream(d, ["license"], 12, 5), lambda d: tracks.valid_tracks(d, ["license"], 12, 5), ("license", "id", "track_start")),
        "stalled": (lambda d: state.stalled_stream(d, 30, 4.0, 20.0, 60.0), lambda d: anomaly.stalled_episodes(d, 30, 4.0, 20.0, 60.0), ("plate", "start_ts", "end_ts")),
    }
    run = jobs.StreamRun(str(tmp_path / "ckpt"), str(tmp_path / "out"), drain=True)
    for k in range(3):
        part = all_rows[k * len(all_rows) // 3:(k + 1) * len(all_rows) // 3]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(source)
        for name, (make, _, _) in runs.items():
            jobs.await_all(spark, run.start(make(spark.readStream.schema(df.schema).parquet(source)), name))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == state.PROVIDER
    for name, (_, batch, cols) in runs.items():
        assert list((tmp_path / "ckpt" / name / "state").rglob("*.changelog")), name
        assert table(spark.read.parquet(f"{run.tables}/{name}"), *cols) == table(batch(df), *cols) != [], name


def test_spot_rows_pass_beside_the_state(spark, rows, stream, run):
    df = rows({"s": 0}, {"s": 1, "type": "parked", "spot": "PS-1"}, {"s": 2, "type": "empty", "spot": "PS-1"}, {"s": 2.5, "type": None}, {"s": 3}, END)
    jobs.await_all(spark, jobs.start_scene(run, stream(df, 2), 5))
    got = spark.read.parquet(f"{run.tables}/scene").where("object_id = 'o1'")
    assert table(got, "id", "removed") == [("0000", "0"), ("0001", "0"), ("0002", "1"), ("0004", "0"), ("0004", "1")]


def test_state_tables(spark, rows, stream, run):
    df = rows(*traffic(), {"s": 1, "type": "parked", "spot": None})
    jobs.await_all(spark, jobs.start_state_tables(run, stream(df)))
    state_now = writers.read_spot_state(spark, f"{run.tables}/spot_state")
    assert table(state_now, "spot", "id") == table(occupancy.spot_state(df), "spot", "id")
    history = spark.read.parquet(f"{run.tables}/spot_history")
    assert table(history, "id") == table(occupancy.spot_history(df), "id")
    aisle = spark.read.parquet(f"{run.tables}/aisle")
    assert table(aisle, "id") == table(df.where("type not in ('parked', 'empty')"), "id")
    assert spark.read.parquet(f"{run.tables}/spot_rejected").count() == 1


def test_repeated_batch_changes_nothing(spark, rows, tmp_path):
    df, path = rows(*traffic(30)), str(tmp_path / "state")
    for batch in (0, 1, 1):
        writers.upsert_spot_state(df.where(F.col("ts") < F.lit("2024-01-01 12:07:00")) if batch == 0 else df, path, batch)
    assert table(writers.read_spot_state(spark, path), "spot", "id") == table(occupancy.spot_state(df), "spot", "id")
    assert spark.read.parquet(path).where("batch = 1").count() == occupancy.spot_state(df).count()


def test_lists_and_validation_streams(spark, rows, stream, run):
    df = rows({"s": 0, "type": "entry", "license": "W"}, {"s": 1, "type": "exit", "license": "B"}, {"s": 2, "type": "exit"})
    lists = [spark.createDataFrame([(v,)], "license string") for v in "WB"]
    jobs.await_all(spark, jobs.start_lists(run, stream(df, 1), *lists))
    got = spark.read.parquet(f"{run.tables}/lists")
    assert sorted(r.key for r in got.collect()) == ["Blacklist", "Whitelist"]


def test_raw_messages(spark, rows, run, tmp_path):
    det = rows({"s": 0, "type": "entry"}, {"s": 1, "type": "parked", "spot": "PS-9"})
    raw = str(tmp_path / "raw")
    adapter.wire(det).unionByName(spark.createDataFrame([("k", "{oops")], "key string, value string")).write.json(raw)
    src = readers.rate_limited_source(spark, "json", {"path": raw})
    jobs.await_all(spark, jobs.start_validation(run, src), jobs.start_pass_through(run, src, "k" * 32, "i" * 16))
    assert [r.value for r in spark.read.parquet(f"{run.tables}/invalid").collect()] == ["{oops"]
    passed = p.to_detections(p.parse_events(spark.read.parquet(f"{run.tables}/events"))).where("id is not null")
    want = det.select("id", p.encrypt_plate("license", "k" * 32, "i" * 16).alias("license"))
    assert table(passed, "id", "license") == table(want, "id", "license")
    again = readers.read_events(spark, "json", {"path": raw})
    assert again.columns == ["key", "value"] and again.count() == 3


def test_stream_tracker_goes_on_across_batches(spark, rows, stream, run, tmp_path):
    cfg = TrackerConfig()
    items = []
    for f in range(12):
        items.append({"s": f * 0.5 + 0.1, "x": float(f), "license": "Q1" if f == 4 else "", "object_id": f"a{f}"})
        if f != 5:
            items.append({"s": f * 0.5 + 0.2, "x": 200.0 - 2 * f, "license": "", "object_id": f"b{f}", "sensor": "C2"})
    items.append({"s": 3.0, "type": "parked", "spot": "PS-1", "object_id": "p"})
    df = rows(*items)
    want = track_batch(df, cfg=cfg).rows
    tracker = StreamTracker(str(tmp_path / "tracker"), cfg)
    jobs.await_all(spark, start_tracker(run, stream(df, 3), tracker))
    got = spark.read.parquet(f"{tracker.tables}/tracked")
    cols = ("id", "license", "object_id", "track_id", "heading", "record_class")
    assert table(got, *cols) == table(want, *cols)
    assert got.select("track_id").where("track_id is not null").distinct().count() == 2


def test_triggers_inside_frames_change_nothing(spark, rows, tmp_path):
    cfg = TrackerConfig()
    items = []
    for f in range(9):
        for k, (x, sensor) in enumerate(((float(f), "C1"), (f + 1.0, "C2"), (200.0 - 2 * f, "C3"))):
            items.append({"s": f * 0.5 + 0.1 * (k + 1), "x": x, "license": "", "object_id": f"{k}-{f}", "sensor": sensor})
    df = rows(*items)
    want = track_batch(df, cfg=cfg).rows
    cols = ("id", "license", "object_id", "track_id", "heading", "record_class")
    for name, cuts, delay in (("two", 2, 0.0), ("shuffled", 4, 1.0)):
        tracker = StreamTracker(str(tmp_path / name), cfg, delay_s=delay)
        order = [r.id for r in df.select("id").orderBy("id").collect()]
        if delay:  # some rows of a frame come one batch late
            order[3], order[5] = order[5], order[3]
            order[10], order[13] = order[13], order[10]
        for n, at in enumerate(range(0, len(order), -(-len(order) // cuts))):
            tracker.step(df.where(F.col("id").isin(order[at:at + -(-len(order) // cuts)])), n)
        tracker.finish(df.limit(0))
        assert table(spark.read.parquet(f"{tracker.tables}/tracked"), *cols) == table(want, *cols), name


def test_files_and_lists(spark, rows, tmp_path):
    (tmp_path / "plates.txt").write_text(" AB1 \n\nAB1\nCD2\n")
    assert table(readers.read_plate_list(spark, str(tmp_path / "plates.txt")), "license") == [("AB1",), ("CD2",)]
    (tmp_path / "spots.csv").write_text("SpotId\nPS-1\nPS-2\nPS-1\n")
    assert readers.read_spots(spark, str(tmp_path / "spots.csv")).count() == 2
    det = rows({"s": 0, "type": "entry"}, {"s": 10, "type": "reset"}, {"s": 20, "type": "exit"}, {"s": 30, "type": "exit"})
    adapter.wire(det).select("value").write.text(str(tmp_path / "lines"))
    got = readers.read_detection_lines(spark, str(tmp_path / "lines"), "2024-01-01 12:00:00", "2024-01-01 12:00:30")
    assert table(got, "messageid") == [("0000",), ("0002",)]


def test_monthly_index(spark, rows, tmp_path):
    df = rows({"s": 0, "type": "entry"}, {"s": 0, "type": "entry"}, {"s": 0, "type": "exit"})
    writers.write_monthly_index(df, str(tmp_path / "ix"), "alert", distinct=True)
    got = spark.read.parquet(str(tmp_path / "ix"))
    assert table(got, "index_type", "year", "month") == [("alert", "2024", "1")] * 2


def test_scene_fold_is_the_visible_scene(rows):
    df = rows({"s": 0, "type": "parked", "spot": "PS-1", "object_id": "p"}, {"s": 1, "object_id": "m"}, {"s": 9, "object_id": "n"})
    t = "2024-01-01 12:00:10"
    assert table(scene.visible(df, t), "object_id", "state") == [("n", "moving"), ("p", "parked")]
    gone = scene.scene_delta(df, "2024-01-01 12:00:05", "2024-01-01 12:00:06")
    assert table(gone, "object_id", "removed") == [("m", "1")]


def test_a_row_sent_again_in_another_batch_is_one_row(spark, rows, tmp_path):
    df = rows({"s": 1, "type": "parked", "spot": "PS-1"}, {"s": 2, "type": "empty", "spot": "PS-1"}, {"s": 3, "spot": None})
    path = str(tmp_path)
    for batch in (0, 1):
        writers.append_spot_history(df, f"{path}/history", batch)
        writers.append_aisle(df, f"{path}/aisle", batch)
        writers.write_monthly_index(df.select("id", "ts", "type", "license"), f"{path}/index", "anomaly", batch, distinct=True)
    for table, kind, n in (("history", "spot_history", 2), ("aisle", "aisle", 1), ("index", "anomalies", 3)):
        assert spark.read.parquet(f"{path}/{table}").count() == 2 * n
        assert writers.read_table(spark, f"{path}/{table}", kind).count() == n
        writers.compact(spark, f"{path}/{table}", f"{path}/{table}-now", kind)
        assert spark.read.parquet(f"{path}/{table}-now").count() == n
