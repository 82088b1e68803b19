"""Search, feeds and indexes."""

from pyspark.sql import functions as F

from spotflow.catalog.base import query, us
from spotflow.operators import anomaly, projections, search
from spotflow.sources import adapter, writers

HOUR = 3600
T0, T1 = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
BETWEEN = f"ts >= TIMESTAMP '{T0}' AND ts <= TIMESTAMP '{T1}'"


@query("search", f"""WITH {{D}} SELECT id, epoch_us(ts) AS ts, type, license, spot FROM d
WHERE {BETWEEN} AND spot = 'PS-7' AND type IN ('entry', 'parked') AND sensor <> 'C3'""")
def find(d):
    out = search.search(d, ["PS-7"], ["entry", "PARKED"], ["c3"], T0, T1)
    return out.select("id", us("ts"), "type", "license", "spot")


@query("recent_events", """WITH {D} SELECT id, license, epoch_us(ts) AS ts, level, type, video FROM d WHERE type = 'exit'
ORDER BY ts DESC, id DESC LIMIT 25""")
def recent_events(d):
    return search.recent_events(d, 25, all_of=["exit"]).select("id", "license", us("ts"), "level", "type", "video")


@query("event_hit_view", "WITH {D} SELECT id, license, epoch_us(ts) AS ts, level, type, video FROM d")
def event_hits(d):
    return search.event_hits(d).select("id", "license", us("ts"), "level", "type", "video")


STAYS = """n AS (SELECT *, lead(ts) OVER w AS end_ts, lead(type) OVER w AS next_type, lead(video) OVER w AS exit_video
  FROM d WHERE type IN ('parked', 'empty') WINDOW w AS (PARTITION BY site, level, spot ORDER BY ts, id)),
al AS (SELECT license, end_ts AS ts, level, 'Overstay, ' || CAST(((epoch_us(end_ts) // 1000 - epoch_us(ts) // 1000 + 18000) // 36000) / 100.0 AS VARCHAR) || ' hrs' AS description,
  video AS entry_video, exit_video, end_ts FROM n WHERE type = 'parked' AND next_type = 'empty'
  AND ((epoch_us(end_ts) // 1000) - (epoch_us(ts) // 1000)) / 3600000.0 > 2)"""
ALERT = "license, epoch_us(ts) AS ts, level, description, entry_video, exit_video, epoch_us(end_ts) AS end_ts"


def _alerts(d):
    return projections.build_overstay(anomaly.overstay(d, 2))


def _alert_cols(df):
    return df.select("license", us("ts"), "level", "description", "entry_video", "exit_video", us("end_ts"))


@query("alert_hit_view", f"WITH {{D}}, {STAYS} SELECT {ALERT} FROM al")
def alert_hits(d):
    return _alert_cols(search.alert_hits(_alerts(d)))


@query("recent_alerts", f"WITH {{D}}, {STAYS} SELECT {ALERT} FROM al WHERE {BETWEEN} ORDER BY al.ts DESC LIMIT 25")
def recent_alerts(d):
    return _alert_cols(search.recent_alerts(_alerts(d), 25, T0, T1))


SOME_BLANK = "SELECT id, ts, level, type, video, CASE WHEN id % 10 = 0 THEN '' ELSE license END AS license FROM d"


def _some_blank(d):
    return d.withColumn("license", F.when(F.col("id") % 10 == 0, "").otherwise(F.col("license")))


COMPRESS = """SELECT * FROM {src} WHERE type <> 'moving' OR license = ''
  UNION ALL (SELECT * FROM {src} WHERE type = 'moving' AND license <> '' QUALIFY row_number() OVER (PARTITION BY license ORDER BY ts DESC, id DESC) <= 2)"""


@query("compress_events", f"WITH {{D}}, b AS ({SOME_BLANK}), c AS ({COMPRESS.format(src='b')}) SELECT id, type, license FROM c")
def compress_events(d):
    return search.compress_events(_some_blank(d), 2).select("id", "type", "license")


@query("event_feed", f"""WITH {{D}}, b AS ({SOME_BLANK}), r AS (SELECT * FROM b ORDER BY ts DESC, id DESC LIMIT 200),
c AS ({COMPRESS.format(src='r')}) SELECT id, license, epoch_us(ts) AS ts, type FROM c ORDER BY c.ts DESC, id DESC LIMIT 25""")
def event_feed(d):
    return search.event_feed(_some_blank(d)).select("id", "license", us("ts"), "type")


@query("refill_panel", """WITH {D}, n AS (SELECT id, ts FROM d WHERE type = 'moving' ORDER BY ts DESC, id DESC LIMIT 7),
o AS (SELECT id, ts FROM d WHERE type = 'exit' ORDER BY ts DESC, id DESC LIMIT 13)
SELECT id, epoch_us(ts) AS ts, true AS is_new FROM n UNION ALL SELECT id, epoch_us(ts) AS ts, false AS is_new FROM o""")
def refill_panel(d):
    new = search.recent(d.where("type = 'moving'"), 7)
    old = search.recent(d.where("type = 'exit'"), 25)
    return search.refill_panel(new, old, 20).select("id", us("ts"), "is_new")


@query("write_monthly_index", """WITH {D} SELECT 'event' AS index_type, year(ts) AS year, month(ts) AS month, site, count(*) AS n FROM d GROUP BY ALL""")
def monthly_index(d):
    return search.monthly(d, "event").groupBy(
        "index_type", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "site"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_anomalies", """WITH {D} SELECT sha1(strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.%gZ') || '|' || type || '|' || license) AS fingerprint
FROM d GROUP BY 1""")
def distinct_anomalies(d):
    sent = d.withColumn("ts", F.date_trunc("hour", "ts"))
    return search.distinct_anomalies(sent).select("fingerprint")


# -- messages -----------------------------------------------------------------------------


@query("write_anomalies", f"WITH {{D}}, {STAYS} SELECT 'Overstay' AS key, license, description, strftime(end_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ended FROM al")
def anomaly_messages(d):
    sent = writers.messages(_alerts(d), F.col("event.type"))
    return sent.select(
        "key", F.get_json_object("value", "$.object.vehicle.license").alias("license"),
        F.get_json_object("value", "$.analyticsModule.description").alias("description"),
        F.get_json_object("value", "$.endTimestamp").alias("ended"))


@query("write_pass_through", "WITH {D} SELECT CAST(id AS VARCHAR) AS key, type, site, true AS hidden, true AS placed FROM d")
def pass_through(d):
    sent = writers.pass_through(adapter.nested(d), "k" * 32, "i" * 16)
    plate = F.get_json_object("value", "$.object.vehicle.license")
    return sent.select(
        "key", F.get_json_object("value", "$.event.type").alias("type"), F.get_json_object("value", "$.place.name").alias("site"),
        (~plate.startswith("V") | (F.length(plate) == 24)).alias("hidden"), F.col("partition").between(0, 7).alias("placed"))


@query("write_tracked", "WITH {D} SELECT sensor AS key, id, license FROM d")
def tracked_messages(d):
    sent = writers.messages(d, F.col("sensor"))
    return sent.select("key", F.get_json_object("value", "$.id").cast("long").alias("id"),
                       F.get_json_object("value", "$.license").alias("license"))
