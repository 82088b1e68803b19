"""Streaming queries over the events table, worked off to the end.

Results go to parquet tables in the session's shared folder. The stream is the
events file plus nothing: windows and timers that the last row leaves open stay
open, which the SQL takes into account.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotflow.catalog.anomalies import UNDER, plate_lists
from spotflow.catalog.base import query, r4, us
from spotflow.catalog.tracking import CFG
from spotflow.operators.anomaly import list_anomaly
from spotflow.operators.lineage import shared_folder
from spotflow.operators.quality import invalid_events
from spotflow.sources import adapter, writers
from spotflow.streaming import jobs, state
from spotflow.streaming.tracker import StreamTracker, start_tracker

HOUR, DAY = 3600, 86400


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = adapter.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return adapter.as_detections(raw)


def _drained(spark: SparkSession, found: DataFrame, name: str) -> DataFrame:
    root = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    run = jobs.StreamRun(f"{root}/checkpoints", f"{root}/tables", drain=True)
    schema = found.schema
    jobs.await_all(spark, run.start(found, name))
    return spark.read.schema(schema).parquet(f"{root}/tables/{name}")


@query("flow_rate_stream", """WITH {D}, m AS (SELECT max(ts) - INTERVAL 1 SECOND AS wm FROM d WHERE type IN ('entry', 'exit')),
p AS (SELECT site AS id, type, epoch_us(ts) // 3600000000 AS p FROM d WHERE type IN ('entry', 'exit')),
w AS (SELECT id, type, p + i AS e FROM p, (SELECT unnest(range(1, 7)) AS i))
SELECT id, e * 3600000000 AS timestamp, type, round(count(*) / 6.0, 4) AS count FROM w, m WHERE e * 3600000000 <= epoch_us(wm) GROUP BY ALL""", over="tables")
def flow_rate_stream(spark, sf_dir):
    found = jobs.flow_rate_stream(_stream(spark, sf_dir), 6 * HOUR, HOUR, "1 second")
    return _drained(spark, found, "flow_rate").select("id", us("timestamp"), "type", r4("count"))


@query("understay_stream", f"""WITH {{D}}, {UNDER} SELECT plate, CAST(entry_id AS VARCHAR) AS entry_id, CAST(exit_id AS VARCHAR) AS exit_id,
  epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts FROM u""", over="tables")
def understay_stream(spark, sf_dir):
    found = state.understay_stream(_stream(spark, sf_dir), 12 * HOUR)
    return _drained(spark, found, "understay").select("plate", "entry_id", "exit_id", us("start_ts"), us("end_ts"))


@query("stalled_stream", over="tables")
def stalled_stream(spark, sf_dir):
    found = state.stalled_stream(_stream(spark, sf_dir), 6 * HOUR, 60, 4 * HOUR, DAY)
    return _drained(spark, found, "stalled").select("plate", us("window_start"), us("start_ts"), us("end_ts"), "video")


@query("valid_tracks_stream", """WITH {D}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 86400000000 OR lag(ts) OVER w IS NULL THEN ts END AS o
  FROM d WINDOW w AS (PARTITION BY license ORDER BY ts, id)),
t AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY license ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g),
m AS (SELECT *, max(ts) OVER (PARTITION BY license, s) AS e FROM t)
SELECT license, CAST(id AS VARCHAR) AS id, epoch_us(ts) AS ts, epoch_us(s) AS track_start FROM m WHERE epoch_us(e) - epoch_us(s) > 43200000000""", over="tables")
def valid_tracks_stream(spark, sf_dir):
    found = state.valid_tracks_stream(_stream(spark, sf_dir), ["license"], DAY, 12 * HOUR)
    return _drained(spark, found, "valid_tracks").select("license", "id", us("ts"), us("track_start"))


@query("scene_stream", """WITH {D}, n AS (SELECT *, lead(ts) OVER w AS nxt, (SELECT max(ts) - INTERVAL 1 SECOND FROM d) AS wm FROM d
  WINDOW w AS (PARTITION BY site, level, object_id ORDER BY ts, id)),
k AS (SELECT *, min(CASE WHEN type IN ('moving', 'entry', 'exit') THEN ts END) OVER (PARTITION BY site, level, object_id ORDER BY ts, id
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS again FROM n)
SELECT CAST(id AS VARCHAR) AS id, epoch_us(ts) AS ts, CAST(CASE WHEN type IN ('exit', 'empty') THEN 1 ELSE 0 END AS BIGINT) AS removed FROM d
UNION ALL SELECT CAST(id AS VARCHAR), epoch_us(ts), 1 FROM k WHERE type IN ('moving', 'entry')
  AND (again >= ts + INTERVAL 6 HOUR OR (again IS NULL AND (epoch_us(ts) + 21600000000) // 1000 + 1 <= (epoch_us(wm) // 1000)))""", over="tables")
def scene_stream(spark, sf_dir):
    found = state.scene_stream(_stream(spark, sf_dir), 6 * HOUR)
    return _drained(spark, found, "scene").select("id", us("ts"), F.col("removed").cast("long"))


@query("list_anomaly_stream", """WITH {D} SELECT id, license, CASE WHEN CAST(license[2:] AS INT) % 2 = 0 THEN 'Whitelist' ELSE 'Blacklist' END AS list
FROM d WHERE type IN ('entry', 'exit') AND CAST(license[2:] AS INT) BETWEEN 1 AND 9""", over="tables")
def list_anomaly_stream(spark, sf_dir):
    white, black = plate_lists(adapter.detections(spark, sf_dir))
    found = list_anomaly(_stream(spark, sf_dir), white, black).select("id", "license", "list")
    return _drained(spark, found, "lists")


@query("validate_stream", "WITH {D} SELECT CAST(id AS VARCHAR) AS key FROM d WHERE id % 7 = 0", over="tables")
def validate_stream(spark, sf_dir):
    raw = adapter.wire(_stream(spark, sf_dir))
    cutoff = F.when(F.col("key").cast("long") % 7 == 0, F.expr("left(value, 20)")).otherwise(F.col("value"))
    return _drained(spark, invalid_events(raw.withColumn("value", cutoff)), "invalid").select("key")


@query("state_tables_stream", """WITH {D} SELECT site, level, spot, id, type FROM d
WHERE type IN ('parked', 'empty') QUALIFY row_number() OVER (PARTITION BY site, level, spot ORDER BY ts DESC, id DESC) = 1""", over="tables")
def state_tables_stream(spark, sf_dir):
    root = f"{shared_folder(spark)}/streams/state-{uuid.uuid4().hex}"
    run = jobs.StreamRun(f"{root}/checkpoints", f"{root}/tables", drain=True)
    jobs.await_all(spark, jobs.start_state_tables(run, _stream(spark, sf_dir)))
    return writers.read_spot_state(spark, f"{root}/tables/spot_state").select("site", "level", "spot", "id", "type")


@query("track_stream", over="tables")
def track_stream(spark, sf_dir):
    root = f"{shared_folder(spark)}/streams/tracker-{uuid.uuid4().hex}"
    run = jobs.StreamRun(f"{root}/checkpoints", f"{root}/tables", drain=True)
    tracker = StreamTracker(f"{root}/tables", CFG)
    jobs.await_all(spark, start_tracker(run, _stream(spark, sf_dir), tracker))
    rows = spark.read.parquet(f"{root}/tables/tracked")
    return rows.select("id", "license", "object_id", "track_id", r4("heading"), "record_class")
