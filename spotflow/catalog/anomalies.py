"""Flow, occupancy and anomaly queries."""

from pyspark.sql import functions as F

from spotflow.catalog.base import query, r4, us
from spotflow.operators import anomaly, flow, occupancy, projections
from spotflow.sources import adapter

AT = "2024-01-20 00:00:00"
SINCE = "2024-01-19 12:00:00"
HOUR, DAY = 3600, 86400

FLOW = """p AS (SELECT site AS id, type, epoch_us(ts) // 3600000000 AS p FROM d WHERE type IN ('entry', 'exit')),
w AS (SELECT id, type, p + i AS e FROM p, (SELECT unnest(range(1, 7)) AS i))"""


@query("flow_rate", f"""WITH {{D}}, {FLOW}
SELECT id, e * 3600000000 AS timestamp, type, round(count(*) / 6.0, 4) AS count FROM w GROUP BY ALL""")
def flow_rate(d):
    return flow.flow_rate(d, 6 * HOUR, HOUR).select("id", us("timestamp"), "type", r4("count"))


HOURLY = """p AS (SELECT site AS id, type, epoch_us(ts) // 600000000 AS p FROM d WHERE type IN ('entry', 'exit')),
w AS (SELECT id, type, p + i AS e FROM p, (SELECT unnest(range(1, 7)) AS i)),
ft AS (SELECT id, e * 600000000 AS timestamp, nullif(count(*) FILTER (type = 'entry'), 0) AS entry,
  nullif(count(*) FILTER (type = 'exit'), 0) AS exit FROM w GROUP BY ALL)"""


def _hourly(d):
    return flow.flow_table(flow.flow_rate(d, HOUR, 600))


@query("upsert_flow_rate", f"WITH {{D}}, {HOURLY} SELECT id, timestamp, entry, exit FROM ft")
def flow_table(d):
    return _hourly(d).select("id", us("timestamp"), "entry", "exit")


@query("latest_flow", f"""WITH {{D}}, {HOURLY}
SELECT id, coalesce(arg_max_null(entry, timestamp), 0) || '/hr' AS entry,
  coalesce(arg_max_null(exit, timestamp), 0) || '/hr' AS exit
FROM ft WHERE timestamp < epoch_us(TIMESTAMP '{AT}') GROUP BY id""")
def latest_flow(d):
    return flow.latest_flow(_hourly(d), before=AT)


@query("event_counts", "WITH {D} SELECT type, count(*) AS n FROM d GROUP BY type")
def event_counts(d):
    return d.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# -- spots -------------------------------------------------------------------------

@query("capacity", "WITH {D} SELECT site, count(DISTINCT (level, spot)) AS total FROM d GROUP BY site")
def capacity(d):
    return occupancy.capacity(adapter.spots(d), "site")


@query("read_spots", "WITH {D} SELECT site, level, spot FROM d GROUP BY ALL")
def read_spots(d):
    return adapter.spots(d)


@query("upsert_spot_state", """WITH {D} SELECT site, level, spot, id, epoch_us(ts) AS ts, type, license FROM d
WHERE type IN ('parked', 'empty') QUALIFY row_number() OVER (PARTITION BY site, level, spot ORDER BY ts DESC, id DESC) = 1""")
def spot_state(d):
    return occupancy.spot_state(d).select("site", "level", "spot", "id", us("ts"), "type", "license")


@query("append_spot_history", """WITH {D} SELECT site, level, spot, sensor, id, epoch_us(ts) AS ts, type, license FROM d
WHERE type IN ('parked', 'empty') QUALIFY row_number() OVER (PARTITION BY site, level, spot, sensor, ts ORDER BY id DESC) = 1""")
def spot_history(d):
    return occupancy.spot_history(d).select("site", "level", "spot", "sensor", "id", us("ts"), "type", "license")


@query("append_aisle", """WITH {D} SELECT site || '-' || level AS messageid, id, epoch_us(ts) AS ts, type, license, x, y
FROM d WHERE type NOT IN ('parked', 'empty')""")
def aisle(d):
    return occupancy.aisle_rows(d).select("messageid", "id", us("ts"), "type", "license", "x", "y")


AS_OF = """s AS (SELECT DISTINCT site, level, spot FROM d),
h AS (SELECT site, level, spot, arg_max(id, (ts, id)) AS id, arg_max(type, (ts, id)) AS type FROM d
  WHERE type IN ('parked', 'empty') AND ts <= TIMESTAMP '{at}' {since} GROUP BY ALL),
a AS (SELECT s.site, s.level, s.spot, h.id, h.type FROM s LEFT JOIN h USING (site, level, spot))"""
AS_OF_ALL = AS_OF.format(at=AT, since="")


@query("spots_as_of", f"WITH {{D}}, {AS_OF_ALL} SELECT site, level, spot, id, type FROM a")
def spots_as_of(d):
    return occupancy.spots_as_of(adapter.spots(d), d, AT).select("site", "level", "spot", "id", "type")


@query("spots_as_of_since", "WITH {D}, " + AS_OF.format(at=AT, since=f"AND ts >= TIMESTAMP '{SINCE}'")
       + " SELECT site, level, spot, id, type FROM a")
def spots_as_of_since(d):
    return occupancy.spots_as_of(adapter.spots(d), d, AT, SINCE).select("site", "level", "spot", "id", "type")


OCC = """o AS (SELECT site, count(*) AS total, count(*) FILTER (type = 'parked') AS occupied FROM a GROUP BY site)"""


@query("occupancy", f"""WITH {{D}}, {AS_OF_ALL}, {OCC}
SELECT site, total, least(occupied, total) AS occupied, greatest(total - occupied, 0) AS available FROM o""")
def occupied(d):
    return occupancy.occupancy(adapter.spots(d), d, AT)


@query("site_stats", f"""WITH {{D}}, {AS_OF_ALL}, {OCC}, {HOURLY},
lf AS (SELECT id, arg_max_null(entry, timestamp) AS entry, arg_max_null(exit, timestamp) AS exit FROM ft
  WHERE timestamp < epoch_us(TIMESTAMP '{AT}') GROUP BY id)
SELECT o.site AS id, greatest(total - occupied, 0) AS free_spots, least(occupied, total) AS occupied_spots,
  coalesce(entry, 0) || '/hr' AS entry_flow, coalesce(exit, 0) || '/hr' AS exit_flow
FROM o LEFT JOIN lf ON o.site = lf.id""")
def site_stats(d):
    return occupancy.site_stats(adapter.spots(d), d, _hourly(d), AT)


# -- stays ---------------------------------------------------------------------------

STAYS = """n AS (SELECT *, lead(ts) OVER w AS end_ts, lead(type) OVER w AS next_type, lead(video) OVER w AS exit_video
  FROM d WHERE type IN ('parked', 'empty') WINDOW w AS (PARTITION BY site, level, spot ORDER BY ts, id)),
v AS (SELECT *, (epoch_us(end_ts) // 1000) - (epoch_us(ts) // 1000) AS ms FROM n WHERE type = 'parked')"""


@query("spot_intervals", f"""WITH {{D}}, {STAYS} SELECT id, site, level, spot, license, epoch_us(ts) AS start_ts,
  epoch_us(end_ts) AS end_ts, next_type, video AS entry_video, exit_video FROM v""")
def spot_intervals(d):
    return anomaly.spot_intervals(d).select(
        "id", "site", "level", "spot", "license", us("start_ts"), us("end_ts"), "next_type", "entry_video", "exit_video")


@query("overstay", f"""WITH {{D}}, {STAYS} SELECT id, site, level, spot, license, epoch_us(ts) AS start_ts,
  epoch_us(end_ts) AS end_ts, ((ms + 180) // 360) / 10000.0 AS hours FROM v WHERE next_type = 'empty' AND ms > 7200000""")
def overstay(d):
    return anomaly.overstay(d, 2).select(
        "id", "site", "level", "spot", "license", us("start_ts"), us("end_ts"), r4("hours"))


@query("overstay_open", f"""WITH {{D}}, {STAYS} SELECT id, spot, next_type,
  (((epoch_us(coalesce(end_ts, TIMESTAMP '2024-02-01 00:00:00')) // 1000) - (epoch_us(ts) // 1000) + 180) // 360) / 10000.0 AS hours
FROM v WHERE (next_type = 'empty' OR next_type IS NULL)
  AND ((epoch_us(coalesce(end_ts, TIMESTAMP '2024-02-01 00:00:00')) // 1000) - (epoch_us(ts) // 1000)) / 3600000.0 > 2""")
def overstay_open(d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return anomaly.overstay(d, 2, include_open=True, now=now).select("id", "spot", "next_type", r4("hours"))


UNDER = """k AS (SELECT *, last_value(CASE WHEN type = 'entry' THEN id END IGNORE NULLS) OVER w AS entry_id
  FROM d WHERE type IN ('entry', 'exit') WINDOW w AS (PARTITION BY upper(trim(license)) ORDER BY ts, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT k.license AS plate, k.entry_id, e.ts AS start_ts, e.video AS entry_video, e.site, e.level,
    k.id AS exit_id, k.ts AS end_ts, k.video AS exit_video
  FROM k JOIN d e ON e.id = k.entry_id
  WHERE k.type = 'exit' AND k.ts > e.ts AND epoch_us(k.ts) - epoch_us(e.ts) < 43200000000
  QUALIFY row_number() OVER (PARTITION BY k.license, k.entry_id ORDER BY k.ts, k.id) = 1)"""


@query("understay", f"""WITH {{D}}, {UNDER} SELECT plate, entry_id, exit_id, epoch_us(start_ts) AS start_ts,
  epoch_us(end_ts) AS end_ts, entry_video, exit_video FROM u""")
def understay(d):
    return anomaly.understay(d, 12 * HOUR).select(
        "plate", "entry_id", "exit_id", us("start_ts"), us("end_ts"), "entry_video", "exit_video")


# -- lists ---------------------------------------------------------------------------------

def plate_lists(d):
    """Plates V1 to V9: even ones white, odd ones black."""
    listed = d.select("license").distinct().where(F.col("license").rlike("^V[1-9]$"))
    even = F.substring("license", 2, 1).cast("int") % 2 == 0
    return listed.where(even), listed.where(~even)


LISTED = """l AS (SELECT *, CASE WHEN CAST(license[2:] AS INT) % 2 = 0 THEN 'Whitelist' ELSE 'Blacklist' END AS list
  FROM d WHERE type IN ('entry', 'exit') AND CAST(license[2:] AS INT) BETWEEN 1 AND 9)"""


@query("list_anomaly", f"WITH {{D}}, {LISTED} SELECT id, license, type, list FROM l")
def list_anomaly(d):
    return anomaly.list_anomaly(d, *plate_lists(d)).select("id", "license", "type", "list")


@query("unlisted", """WITH {D} SELECT id, license FROM d WHERE type IN ('entry', 'exit')
  AND NOT (CAST(license[2:] AS INT) BETWEEN 1 AND 9)""")
def unlisted(d):
    return anomaly.unlisted(d, *plate_lists(d)).select("id", "license")


# -- anomaly rows -----------------------------------------------------------------------------

def _anomaly(df):
    return df.select(
        "mdsversion", us("timestamp"), us("startTimestamp", "start_us"), us("endTimestamp", "end_us"),
        F.col("place.name").alias("site"), F.col("object.vehicle.license").alias("license"),
        F.col("event.type").alias("kind"), F.col("analyticsModule.source").alias("source"),
        F.col("analyticsModule.description").alias("description"),
        F.col("entryVideo").alias("entry_video"), F.col("exitVideo").alias("exit_video"),
        F.col("aisleVideo").alias("aisle_video"),
    )


def _anomaly_sql(source, kind, stamp, start, end, text, entry, exit_, aisle="''", license="license"):
    return f"""SELECT '1.0' AS mdsversion, epoch_us({stamp}) AS timestamp, epoch_us({start}) AS start_us,
  epoch_us({end}) AS end_us, site, {license} AS license, '{kind}' AS kind, 'AM-{kind}' AS source,
  {text} AS description, {entry} AS entry_video, {exit_} AS exit_video, {aisle} AS aisle_video FROM {source}"""


@query("build_overstay", f"WITH {{D}}, {STAYS} " + _anomaly_sql(
    "v WHERE next_type = 'empty' AND ms > 7200000", "Overstay", "end_ts", "ts", "end_ts",
    "'Overstay, ' || CAST(((ms + 18000) // 36000) / 100.0 AS VARCHAR) || ' hrs'", "video", "exit_video"))
def build_overstay(d):
    return _anomaly(projections.build_overstay(anomaly.overstay(d, 2)))


@query("build_understay", f"WITH {{D}}, {UNDER} " + _anomaly_sql(
    "u", "Understay", "start_ts", "start_ts", "end_ts",
    "'Short Stay ' || CAST(((epoch_us(end_ts) // 1000 - epoch_us(start_ts) // 1000 + 300) // 600) / 100.0 AS VARCHAR) || ' minutes'",
    "entry_video", "exit_video", license="plate"))
def build_understay(d):
    return _anomaly(projections.build_understay(anomaly.understay(d, 12 * HOUR)))


@query("build_list_anomaly", f"WITH {{D}}, {LISTED} " + " UNION ALL ".join(
    _anomaly_sql(f"l WHERE list = '{k}'", k, "ts", "ts", "ts", f"'this car is {k}ed'",
                 "CASE WHEN type = 'entry' THEN video ELSE '' END", "CASE WHEN type = 'exit' THEN video ELSE '' END")
    for k in ("Whitelist", "Blacklist")))
def build_list_anomaly(d):
    return _anomaly(projections.build_list_anomaly(anomaly.list_anomaly(d, *plate_lists(d))))


STALLED = """m AS (SELECT license AS plate, epoch_us(ts) // 172800000000 AS w, min(ts) AS start_ts, max(ts) AS end_ts,
    arg_max(video, (ts, id)) AS last_video, arg_min(site, (ts, id)) AS site, bool_or(type = 'entry') AS e,
    max(x) - min(x) AS dx, max(y) - min(y) AS dy
  FROM d WHERE type NOT IN ('parked', 'empty') GROUP BY ALL),
st AS (SELECT *, CASE WHEN e THEN '' ELSE last_video END AS video FROM m
  WHERE dx <= 60 AND dy <= 60 AND (epoch_us(end_ts) // 1000) - (epoch_us(start_ts) // 1000) >= 43200000)"""


@query("stalled_windows", f"""WITH {{D}}, {STALLED} SELECT plate, w * 172800000000 AS window_start,
  epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, video FROM st""")
def stalled_windows(d):
    return anomaly.stalled_windows(d, 2 * DAY, 60, 12 * HOUR).select(
        "plate", us("window_start"), us("start_ts"), us("end_ts"), "video")


@query("build_stalled", f"WITH {{D}}, {STALLED} " + _anomaly_sql(
    "st", "UnexpectedStopping", "start_ts", "start_ts", "end_ts",
    "'Unexpected Stopping ' || CAST(((epoch_us(end_ts) // 1000 - epoch_us(start_ts) // 1000 + 5) // 10) / 100.0 AS VARCHAR) || ' seconds'",
    "''", "''", "video", "plate"))
def build_stalled(d):
    return _anomaly(projections.build_stalled(anomaly.stalled_windows(d, 2 * DAY, 60, 12 * HOUR)))


EPISODES = """m AS (SELECT license AS plate, epoch_us(ts) // 21600000000 AS w, min(epoch_us(ts)) // 1000 AS ms, max(epoch_us(ts)) // 1000 AS last_ms,
    arg_min(x, (ts, id)) AS x, arg_min(y, (ts, id)) AS y, bool_or(type = 'entry') AS e, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2,
    coalesce(arg_max_null(video, (ts, id)), '') AS own FROM d WHERE type NOT IN ('parked', 'empty') GROUP BY ALL),
n AS (SELECT *, CASE WHEN e THEN '' ELSE own END AS seen, row_number() OVER (PARTITION BY plate ORDER BY w) AS i FROM m),
f AS (SELECT plate, 0::BIGINT AS i, 0::BIGINT AS w, FALSE AS live, FALSE AS armed, 0::BIGINT AS ams, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0::BIGINT AS till, '' AS video, FALSE AS hit
    FROM n WHERE i = 1
  UNION ALL SELECT plate, i, w,
    NOT ended AND (goes OR x2 - x1 <= 60 AND y2 - y1 <= 60) AS live, NOT goes OR stays AS armed,
    CASE WHEN goes THEN ams ELSE ms END, CASE WHEN goes THEN ax ELSE x END, CASE WHEN goes THEN ay ELSE y END,
    CASE WHEN goes AND NOT stays THEN till ELSE last_ms END,
    CASE WHEN goes AND (NOT stays OR video = '') THEN video ELSE seen END,
    CASE WHEN ended THEN FALSE WHEN goes THEN stays ELSE x2 - x1 <= 60 AND y2 - y1 <= 60 AND last_ms - ms >= 14400000 END
  FROM (SELECT n.*, f.ams, f.ax, f.ay, f.till, f.video, f.live AND n.ms - f.till > 86400000 AND NOT f.armed AS ended,
      f.live AND n.ms - f.till <= 86400000 AS goes, n.last_ms - f.ams >= 14400000
        AND greatest(n.x2, f.ax) - least(n.x1, f.ax) < 60 AND greatest(n.y2, f.ay) - least(n.y1, f.ay) < 60 AS stays
    FROM f JOIN n ON n.plate = f.plate AND n.i = f.i + 1))"""


@query("stalled_episodes", f"""WITH RECURSIVE {{D}}, {EPISODES} SELECT plate, w * 21600000000 AS window_start,
  ams * 1000 AS start_ts, till * 1000 AS end_ts, video FROM f WHERE hit""")
def stalled_episodes(d):
    return anomaly.stalled_episodes(d, 6 * HOUR, 60, 4 * HOUR, DAY).select(
        "plate", us("window_start"), us("start_ts"), us("end_ts"), "video")
