"""Regions, lines, nodes, cameras, tracks and scenes."""

from pyspark.sql import functions as F

from spotflow.catalog.base import query, r4, us
from spotflow.operators import regions, scene, tracks

HOUR, DAY = 3600, 86400
AT = "2024-01-20 00:00:00"

# -- regions -------------------------------------------------------------------------


def _boxes(d):
    """Per sensor a box around the middle of what it sees, and a second one beside it."""
    mid = d.groupBy("sensor").agg(F.floor(F.avg("x")).alias("mx"), F.floor(F.avg("y")).alias("my"))

    def ring(dx):
        x1, x2, y1, y2 = F.col("mx") + dx - 10.0, F.col("mx") + dx + 10.0, F.col("my") - 10.0, F.col("my") + 10.0
        return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])

    return mid.select("sensor", F.explode(F.array(ring(0), ring(40))).alias("ring"))


INSIDE = """b AS (SELECT sensor, floor(avg(x)) AS mx, floor(avg(y)) AS my FROM d GROUP BY sensor),
f AS (SELECT d.*, type NOT IN ('parked', 'empty') AND y > my - 10 AND y < my + 10 AND ((x > mx - 10 AND x < mx + 10)
  OR (x > mx + 30 AND x < mx + 50)) AS ignored FROM d JOIN b USING (sensor))"""


@query("ignore_region_join", f"WITH {{D}}, {INSIDE} SELECT id, ignored FROM f")
def ignore_flags(d):
    return regions.ignore_flags(d, _boxes(d)).select("id", "ignored")


@query("outside_ignore_regions", f"WITH {{D}}, {INSIDE} SELECT id FROM f WHERE NOT ignored")
def kept(d):
    return regions.outside_ignore_regions(d, _boxes(d))[0].select("id")


@query("inside_ignore_regions", f"WITH {{D}}, {INSIDE} SELECT id FROM f WHERE ignored")
def ignored(d):
    return regions.outside_ignore_regions(d, _boxes(d))[1].select("id")


# One line per vehicle: from its first to its last position.
LINES = """l AS (SELECT license AS line_id, arg_min(x, id) AS x1, arg_min(y, id) AS y1, arg_max(x, id) AS x2, arg_max(y, id) AS y2
  FROM d GROUP BY license)"""


def _lines(d):
    return d.groupBy(F.col("license").alias("line_id")).agg(
        F.min_by("x", "id").alias("x1"), F.min_by("y", "id").alias("y1"),
        F.max_by("x", "id").alias("x2"), F.max_by("y", "id").alias("y2"))


@query("snap_to_roads", f"""WITH {{D}}, {LINES},
t AS (SELECT id, x, y, line_id, x1, y1, x2, y2, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS q,
  ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) AS p FROM d, l WHERE type = 'moving'),
u AS (SELECT *, CASE WHEN q = 0 THEN 0 ELSE least(greatest(p / q, 0), 1) END AS k FROM t),
v AS (SELECT id, line_id, x1 + (x2 - x1) * k AS sx, y1 + (y2 - y1) * k AS sy,
  sqrt(pow(x - x1 - (x2 - x1) * k, 2) + pow(y - y1 - (y2 - y1) * k, 2)) AS dist FROM u),
w AS (SELECT * FROM v WHERE dist <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), line_id) = 1)
SELECT d.id, round(coalesce(sx, x), 4) AS x, round(coalesce(sy, y), 4) AS y, round(dist, 4) AS snap_distance
FROM d LEFT JOIN w USING (id) WHERE type = 'moving'""")
def snap_to_roads(d):
    moving = d.where("type = 'moving'").select("id", "x", "y")
    return regions.snap_to_roads(moving, _lines(d), 5.0).select("id", r4("x"), r4("y"), r4("snap_distance"))


# Nodes: the places where a vehicle was first seen.
NODES = "n AS (SELECT license AS node_id, arg_min(x, id) AS nx, arg_min(y, id) AS ny FROM d GROUP BY license)"


def _nodes(d):
    return d.groupBy(F.col("license").alias("node_id")).agg(F.min_by("x", "id").alias("x"), F.min_by("y", "id").alias("y"))


@query("nearest_node", f"""WITH {{D}}, {NODES}
SELECT id, round(min(sqrt(pow(x - nx, 2) + pow(y - ny, 2))), 4) AS distance FROM d, n GROUP BY id""")
def nearest_node(d):
    return regions.nearest_node(d.select("id", "x", "y"), _nodes(d)).select("id", r4("distance"))


@query("entrance_node", f"""WITH {{D}}, {NODES},
g AS (SELECT id, node_id FROM d, n WHERE type = 'entry' AND sqrt(pow(x - nx, 2) + pow(y - ny, 2)) <= 2
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sqrt(pow(x - nx, 2) + pow(y - ny, 2)), 9), node_id) = 1)
SELECT d.id, g.node_id FROM d LEFT JOIN g USING (id) WHERE type = 'entry'""")
def entrance_node(d):
    gates = d.where("type = 'entry'").select("id", "x", "y")
    return regions.entrance_node(gates, _nodes(d), 2.0).select("id", "node_id")


# Camera rectangles: around the first position of each vehicle, of several sizes.
RECTS = """r AS (SELECT license AS camera, arg_min(x, id) - s AS x1, arg_min(y, id) - s AS y1, arg_min(x, id) + s AS x2,
  arg_min(y, id) + s AS y2 FROM (SELECT *, 1.0 + CAST(license[2:] AS INT) % 4 AS s FROM d) GROUP BY license, s)"""


def _rects(d):
    s = 1.0 + F.expr("substring(camera, 2)").cast("int") % 4
    return _nodes(d).withColumnRenamed("node_id", "camera").select(
        "camera", (F.col("x") - s).alias("x1"), (F.col("y") - s).alias("y1"),
        (F.col("x") + s).alias("x2"), (F.col("y") + s).alias("y2"))


@query("cameras_covering", f"""WITH {{D}}, {RECTS} SELECT id, camera FROM d JOIN r ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2""")
def covering(d):
    return regions.covering(d.select("id", "x", "y"), _rects(d)).select("id", "camera")


@query("camera_roles", f"""WITH {{D}}, {RECTS},
g AS (SELECT camera, max(CAST(type = 'entry' AS INT)) AS i, max(CAST(type = 'exit' AS INT)) AS o
  FROM d JOIN r ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 WHERE type IN ('entry', 'exit') GROUP BY camera)
SELECT r.camera, CAST(coalesce(i, 0) AS BIGINT) AS is_entry_camera, CAST(coalesce(o, 0) AS BIGINT) AS is_exit_camera
FROM r LEFT JOIN g USING (camera)""")
def camera_roles(d):
    out = regions.camera_roles(_rects(d), d.where("type in ('entry', 'exit')"))
    return out.select("camera", F.col("is_entry_camera").cast("long"), F.col("is_exit_camera").cast("long"))


# -- tracks ---------------------------------------------------------------------------------


@query("bounding_box", """WITH {D} SELECT license, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
  round(max(x) - min(x), 4) AS x_extent, round(max(y) - min(y), 4) AS y_extent FROM d GROUP BY license""")
def bounding_box(d):
    return tracks.bounding_box(d, "license").select(
        "license", "x_min", "x_max", "y_min", "y_max", r4("x_extent"), r4("y_extent"))


SESSIONS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 86400000000 OR lag(ts) OVER w IS NULL THEN ts END AS o
  FROM d WINDOW w AS (PARTITION BY license ORDER BY ts, id)),
t AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY license ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS track_start FROM g)"""


@query("track_sessions", f"WITH {{D}}, {SESSIONS} SELECT id, license, epoch_us(track_start) AS track_start FROM t")
def track_sessions(d):
    return tracks.track_sessions(d, ["license"], DAY).select("id", "license", us("track_start"))


@query("valid_tracks", f"""WITH {{D}}, {SESSIONS},
m AS (SELECT *, max(ts) OVER (PARTITION BY license, track_start) AS track_end FROM t)
SELECT id, license, epoch_us(track_start) AS track_start FROM m WHERE epoch_us(track_end) - epoch_us(track_start) > 43200000000""")
def valid_tracks(d):
    return tracks.valid_tracks(d, ["license"], DAY, 12 * HOUR).select("id", "license", us("track_start"))


SMOOTH = """q AS (SELECT license, id, x, y, row_number() OVER w AS k, count(*) OVER (PARTITION BY license) AS t,
    avg(x) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS mx, avg(y) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS my
  FROM d WINDOW w AS (PARTITION BY license ORDER BY ts, id)),
s AS (SELECT license, k - 1 AS seq, x, y FROM q WHERE t < 70
  UNION ALL SELECT license, 0, x, y FROM q WHERE t >= 70 AND k = 1
  UNION ALL SELECT license, k, mx, my FROM q WHERE t >= 70 AND k <= t - 4
  UNION ALL SELECT license, t - 3, x, y FROM q WHERE t >= 70 AND k = t)"""


@query("smooth_track", f"WITH {{D}}, {SMOOTH} SELECT license, seq, round(x, 3) AS x, round(y, 3) AS y FROM s")
def smooth_track(d):
    out = tracks.smooth_track(d, ["license"], threshold=70)
    return out.select("license", "seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("track_summary", f"""WITH {{D}}, {SMOOTH},
l AS (SELECT license, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM s WINDOW w AS (PARTITION BY license ORDER BY seq)),
a AS (SELECT license, coalesce(sum(step), 0) AS distance FROM l GROUP BY license),
b AS (SELECT license, sqrt(pow(arg_min(x, seq) - arg_max(x, seq), 2) + pow(arg_min(y, seq) - arg_max(y, seq), 2)) AS linear FROM s GROUP BY license),
c AS (SELECT license, ((epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000)) / 1000.0 AS duration FROM d GROUP BY license)
SELECT license, round(distance, 3) AS distance, round(linear, 3) AS linear_distance, duration,
  CASE WHEN floor(duration) = 0 THEN 0 ELSE round(distance * 3.6 / floor(duration), 8) END AS speed
FROM a JOIN b USING (license) JOIN c USING (license)""")
def track_summary(d):
    out = tracks.track_summary(d, ["license"], threshold=70)
    return out.select("license", F.round("distance", 3).alias("distance"), F.round("linear_distance", 3).alias("linear_distance"),
                      "duration", F.round("speed", 8).alias("speed"))


@query("heading", """WITH {D}, q AS (SELECT id, license, ts, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM
  (SELECT id, license, ts, floor(x / 50) AS x, floor(y / 50) AS y FROM d) WINDOW w AS (PARTITION BY license ORDER BY ts, id)),
h AS (SELECT *, CASE WHEN px <> x OR py <> y THEN degrees(atan2(y - py, x - px)) END AS raw FROM q),
k AS (SELECT id, license, last_value(CASE WHEN raw < 0 THEN raw + 360 ELSE raw END IGNORE NULLS) OVER (PARTITION BY license ORDER BY ts, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM h)
SELECT id, license, round(heading, 4) AS heading FROM k""")
def heading(d):
    coarse = d.select("id", "license", "ts", F.floor(F.col("x") / 50).alias("x"), F.floor(F.col("y") / 50).alias("y"))
    return tracks.heading(coarse, ["license"]).select("id", "license", r4("heading"))


# -- scenes ------------------------------------------------------------------------------------

VIEW = """epoch_us(ts) AS ts, site, level, object_id, CASE WHEN type IN ('parked', 'empty') THEN spot ELSE '' END AS spot,
  CASE WHEN type IN ('parked', 'empty') THEN type ELSE 'moving' END AS state, type, """
REMOVED = "CAST(CASE WHEN type IN ('exit', 'empty') THEN 1 ELSE 0 END AS BIGINT) AS removed"


def _view(df):
    return df.select("id", us("ts"), "site", "level", "object_id", "spot", "state", "type", F.col("removed").cast("long").alias("removed"))


@query("vehicle_view", f"WITH {{D}} SELECT id, {VIEW} {REMOVED}, x, y, round(37.28728 - y * 0.001 * 360 / 40000, 8) AS lat FROM d")
def vehicle_view(d):
    v = scene.vehicle_view(d)
    return v.select("id", us("ts"), "site", "level", "object_id", "spot", "state", "type", F.col("removed").cast("long").alias("removed"),
                    "x", "y", F.round("lat", 8).alias("lat"))


@query("latest_moving", """WITH {D} SELECT id, epoch_us(ts) AS ts, site, level, object_id FROM d WHERE type NOT IN ('parked', 'empty')
  QUALIFY row_number() OVER (PARTITION BY site, level, object_id ORDER BY ts DESC, id DESC) = 1""")
def latest_moving(d):
    return scene.latest_moving(scene.moving_rows(d)).select("id", us("ts"), "site", "level", "object_id")


SPOTS_AT = """p AS (SELECT * FROM d WHERE type IN ('parked', 'empty') AND ts <= TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY site, level, spot ORDER BY ts DESC, id DESC) = 1)"""


@query("scene_at", f"""WITH {{D}}, {SPOTS_AT},
m AS (SELECT * FROM d WHERE type NOT IN ('parked', 'empty') AND ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY site, level, object_id ORDER BY ts DESC, id DESC) = 1)
SELECT id, {VIEW} {REMOVED} FROM (SELECT * FROM p UNION ALL SELECT * FROM m)""")
def scene_at(d):
    return _view(scene.scene_at(d, AT, back_s=DAY))


RETIRED = """z AS (SELECT * FROM d WHERE type IN ('moving', 'entry', 'exit') AND ts <= TIMESTAMP '2024-01-21'
  QUALIFY row_number() OVER (PARTITION BY site, level, object_id ORDER BY ts DESC, id DESC) = 1),
gone AS (SELECT * FROM z WHERE type <> 'exit' AND ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-20' AND ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-21')"""


@query("scene_delta", f"""WITH {{D}}, {RETIRED},
c AS (SELECT * FROM d WHERE type IN ('parked', 'empty') AND ts > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-21'),
m AS (SELECT * FROM d WHERE type NOT IN ('parked', 'empty') AND ts > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-21'
  QUALIFY row_number() OVER (PARTITION BY site, level, object_id ORDER BY ts DESC, id DESC) = 1)
SELECT id, {VIEW} {REMOVED} FROM (SELECT * FROM c UNION ALL SELECT m.* FROM m ANTI JOIN gone USING (site, level, object_id))
UNION ALL SELECT id, {VIEW} 1 AS removed FROM gone""")
def scene_delta(d):
    return _view(scene.scene_delta(d, AT, "2024-01-21 00:00:00", 6 * HOUR))


@query("visible_vehicles", f"""WITH {{D}}, {SPOTS_AT},
m AS (SELECT * FROM d WHERE type NOT IN ('parked', 'empty') AND ts <= TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY site, level, object_id ORDER BY ts DESC, id DESC) = 1)
SELECT id, {VIEW} {REMOVED} FROM (SELECT * FROM p WHERE type = 'parked' UNION ALL
  SELECT * FROM m WHERE type <> 'exit' AND ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-20')""")
def visible(d):
    return _view(scene.visible(d, AT, 6 * HOUR))
