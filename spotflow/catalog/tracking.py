"""Cameras, pairs, clusters and matching. Frames are half-hours, as the test data is sparse."""

from functools import partial

from pyspark.sql import functions as F

from spotflow.catalog.base import query, r4, us
from spotflow.operators import tracking as t
from spotflow.plans.tracking import TrackerConfig, prepare, spot_pass_through, track_batch

FRAME, NEAR, CARRY = 1800, 20.0, 3 * 3600.0
CFG = TrackerConfig(FRAME, NEAR, NEAR, CARRY)

FRAMES = """f AS (SELECT *, epoch_us(ts) // 1800000000 AS frame FROM d WHERE type NOT IN ('parked', 'empty')),
c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY site, level, frame, sensor, object_id ORDER BY ts DESC, id DESC) = 1)"""


def _frames(d):
    return t.frames(d.where("type not in ('parked', 'empty')"), FRAME)


def _seen(d):
    return t.collapse_frame(_frames(d))


@query("frames", f"WITH {{D}}, {FRAMES} SELECT site, level, frame, count(*) AS n FROM f GROUP BY ALL")
def frames(d):
    return _frames(d).groupBy("site", "level", "frame").agg(F.count(F.lit(1)).alias("n"))


@query("collapse_frame", f"WITH {{D}}, {FRAMES} SELECT id, frame, sensor, object_id FROM c")
def collapse_frame(d):
    return _seen(d).select("id", "frame", "sensor", "object_id")


PREP = """r AS (SELECT *, epoch_us(ts) // 1800000000 AS frame, '^S' || sensor || '_^O' || object_id AS oid, CASE WHEN type = 'parked' THEN 'parked'
  WHEN type = 'empty' THEN 'emptySpots' ELSE 'moving' END AS record_class FROM d)"""


@query("prepare", f"WITH {{D}}, {PREP} SELECT id, frame, oid AS object_id, record_class, level FROM r")
def prepared(d):
    low = d.withColumn("level", F.lower("level"))
    return prepare(low, cfg=CFG).select("id", "frame", "object_id", "record_class", "level")


@query("spot_pass_through", f"WITH {{D}}, {PREP} SELECT id, record_class FROM r WHERE record_class <> 'moving'")
def passed(d):
    return spot_pass_through(prepare(d, cfg=CFG)).select("id", "record_class")


PAIRS = f"""p AS (SELECT a.site, a.level, a.frame, a.id AS id1, b.id AS id2, a.sensor AS sensor1, b.sensor AS sensor2,
    sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance
  FROM c a JOIN c b ON a.site = b.site AND a.level = b.level AND a.frame = b.frame AND a.id < b.id AND a.sensor <> b.sensor
  WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {NEAR})"""


@query("pairs_within_frame", f"WITH {{D}}, {FRAMES}, {PAIRS} SELECT id1, id2, frame, round(distance, 4) AS distance FROM p")
def pairs_within_frame(d):
    return t.pairs_within_frame(_seen(d), NEAR).select("id1", "id2", "frame", r4("distance"))


def _cameras(d, plus, first, second):
    """Camera pairs taken from the cameras that occur."""
    number = F.substring("sensor", 2, 1).cast("int")
    seen = d.select("sensor").distinct()
    return seen.where(number.isin(first, second)).select(
        "sensor", F.concat(F.lit("C"), F.pmod(number + plus, F.lit(5))).alias("other"))


CONFLICT = "((sensor1 = 'C0' AND sensor2 = 'C1') OR (sensor1 = 'C1' AND sensor2 = 'C0') OR (sensor1 = 'C2' AND sensor2 = 'C3') OR (sensor1 = 'C3' AND sensor2 = 'C2'))"


@query("conflicting_cameras", f"WITH {{D}}, {FRAMES}, {PAIRS} SELECT id1, id2, {CONFLICT} AS conflict FROM p")
def conflicting_cameras(d):
    pairs = t.pairs_within_frame(_seen(d), NEAR)
    return t.conflicting_cameras(pairs, _cameras(d, 1, 0, 2)).select("id1", "id2", "conflict")


@query("without_conflicts", f"WITH {{D}}, {FRAMES}, {PAIRS} SELECT id1, id2 FROM p WHERE NOT {CONFLICT}")
def without_conflicts(d):
    return t.without_conflicts(t.pairs_within_frame(_seen(d), NEAR), _cameras(d, 1, 0, 2)).select("id1", "id2")


@query("overlapping_cameras", f"""WITH {{D}}, {FRAMES}, {PAIRS} SELECT id1, id2,
  (least(sensor1, sensor2) = 'C0' AND greatest(sensor1, sensor2) = 'C1')
  OR (sensor1 NOT IN ('C0', 'C1') AND sensor2 NOT IN ('C0', 'C1')) AS overlap FROM p""")
def overlapping_cameras(d):
    pairs = t.pairs_within_frame(_seen(d), NEAR)
    return t.overlapping_cameras(pairs, _cameras(d, 1, 0, 0)).select("id1", "id2", "overlap")


CAND = f"""x AS (SELECT a.id AS id1, b.id AS id2, b.frame, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance, a.object_id = b.object_id AS same
  FROM c a JOIN c b ON a.site = b.site AND a.level = b.level AND b.frame = a.frame + 1),
k AS (SELECT id1, id2, frame, distance, CASE WHEN same THEN 0 ELSE distance END AS cost FROM x WHERE same OR distance <= {NEAR})"""


@query("frame_to_frame_candidates", f"WITH {{D}}, {FRAMES}, {CAND} SELECT id1, id2, frame, round(distance, 4) AS distance, round(cost, 4) AS cost FROM k")
def candidates(d):
    return t.frame_to_frame_candidates(_seen(d), NEAR).select("id1", "id2", "frame", r4("distance"), r4("cost"))


def _mutual(d):
    among = partial(t.frame_to_frame_candidates, _seen(d), NEAR)
    return t.match_mutual_nearest(among(), among)


@query("match_mutual_nearest", f"""WITH {{D}}, {FRAMES}, {CAND},
a AS (SELECT id1, id2 FROM k QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY cost, id2) = 1),
b AS (SELECT id1, id2 FROM k QUALIFY row_number() OVER (PARTITION BY id2 ORDER BY cost, id1) = 1)
SELECT id1, id2, round(cost, 4) AS cost FROM k SEMI JOIN a USING (id1, id2) SEMI JOIN b USING (id1, id2)""")
def mutual_nearest(d):
    found = _mutual(d)
    return found.select("id1", "id2", r4("cost"))


# Clusters for the queries below: what a place shows in a frame.
GROUPED = FRAMES + """, g AS (SELECT *, site || '/' || level || '/' || frame AS cluster, x - 1 AS bbox_left, x + 1 AS bbox_right,
  y + id % 7 AS bbox_bottom, y AS bbox_top, CASE WHEN id % 3 = 0 THEN '' ELSE license END AS plate FROM c)"""


def _grouped(d):
    return _seen(d).select(
        "*", F.concat_ws("/", "site", "level", "frame").alias("cluster"), (F.col("x") - 1).alias("bbox_left"),
        (F.col("x") + 1).alias("bbox_right"), (F.col("y") + F.col("id") % 7).alias("bbox_bottom"), F.col("y").alias("bbox_top"),
    ).withColumn("license", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("license")))


@query("cluster_representative", f"""WITH {{D}}, {GROUPED} SELECT cluster, id FROM g QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY
  CASE WHEN type IN ('entry', 'exit') THEN 0 WHEN video <> '' THEN 1 ELSE 2 END,
  CASE WHEN type IN ('entry', 'exit') OR video <> '' THEN '' ELSE object_id END,
  CASE WHEN type IN ('entry', 'exit') OR video <> '' THEN -epoch_us(ts) ELSE epoch_us(ts) END) = 1""")
def representative(d):
    return t.cluster_representative(_grouped(d)).select("cluster", "id")


@query("cluster_position", f"""WITH {{D}}, {GROUPED} SELECT cluster, x, y FROM g QUALIFY row_number() OVER
  (PARTITION BY cluster ORDER BY greatest(bbox_top, bbox_bottom) DESC, ts, id) = 1""")
def position(d):
    return t.cluster_position(_grouped(d)).select("cluster", "x", "y")


@query("cluster_position_median", f"WITH {{D}}, {GROUPED} SELECT cluster, round(median(x), 3) AS x, round(median(y), 3) AS y FROM g GROUP BY cluster")
def position_median(d):
    out = t.cluster_position(_grouped(d), how="median")
    return out.select("cluster", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


MERGED = """h AS (SELECT cluster, count(DISTINCT nullif(plate, '')) AS n, arg_min(plate, (ts, id)) FILTER (plate <> '') AS p1,
    arg_min(object_id, (ts, id)) FILTER (plate <> '') AS o1, arg_min(object_id, (ts, id)) AS o0 FROM g GROUP BY cluster)"""


@query("merge_attributes", f"""WITH {{D}}, {GROUPED}, {MERGED}
SELECT id, CASE WHEN n = 1 THEN p1 WHEN n = 0 THEN '' ELSE plate END AS license, CASE WHEN n = 1 THEN o1 WHEN n = 0 THEN o0 ELSE object_id END AS object_id
FROM g JOIN h USING (cluster)""")
def merge_attributes(d):
    return t.merge_attributes(_grouped(d)).select("id", "license", "object_id")


@query("cluster_output", f"""WITH {{D}}, {GROUPED}, {MERGED},
q AS (SELECT cluster, count(DISTINCT sensor) AS k, array_to_string(list_sort(list_distinct(list(object_id))), ',') AS ids,
  arg_max(x, (greatest(bbox_top, bbox_bottom), -epoch_us(ts))) AS px, arg_max(y, (greatest(bbox_top, bbox_bottom), -epoch_us(ts))) AS py FROM g GROUP BY cluster),
w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY
  CASE WHEN type IN ('entry', 'exit') THEN 0 WHEN video <> '' THEN 1 ELSE 2 END,
  CASE WHEN type IN ('entry', 'exit') OR video <> '' THEN '' ELSE (SELECT CASE WHEN h.n = 1 THEN h.o1 WHEN h.n = 0 THEN h.o0 ELSE g.object_id END FROM h WHERE h.cluster = g.cluster) END,
  CASE WHEN type IN ('entry', 'exit') OR video <> '' THEN -epoch_us(ts) ELSE epoch_us(ts) END) = 1)
SELECT w.id, CASE WHEN n = 1 THEN p1 WHEN n = 0 THEN '' ELSE plate END AS license, ids, px AS x, py AS y
FROM w JOIN h USING (cluster) JOIN q USING (cluster) WHERE k > 1
UNION ALL SELECT g.id, plate, object_id, x, y FROM g JOIN q USING (cluster) WHERE k = 1""")
def cluster_output(d):
    return t.cluster_output(_grouped(d)).select("id", "license", F.array_join("ids", ",").alias("ids"), "x", "y")


@query("cluster_frame")
def cluster_frame(d):
    return t.cluster_frame(_seen(d), NEAR, _cameras(d, 1, 0, 2)).select("id", "frame", "cluster")


# Ids are linked here through places on a very fine grid which several vehicles passed.
SETS = """i AS (SELECT DISTINCT object_id AS m, floor(x * 10) || ':' || y AS g FROM d),
a AS (SELECT DISTINCT p.m AS u, q.m AS v FROM i p JOIN i q USING (g) WHERE p.m <> q.m)"""


@query("id_sets", f"""WITH RECURSIVE {{D}}, {SETS},
r(m, root) USING KEY (m) AS (SELECT DISTINCT u, u FROM a UNION
  SELECT a.v, min(r.root) FROM r JOIN a ON a.u = r.m JOIN recurring.r AS o ON o.m = a.v WHERE r.root < o.root GROUP BY a.v),
s AS (SELECT root, count(*) AS size FROM r GROUP BY root)
SELECT m AS member, r.root, size FROM r JOIN s ON s.root = r.root""")
def id_sets(d):
    spot = F.concat_ws(":", F.floor(F.col("x") * 10), "y")
    rows = d.withColumn("cluster", spot)
    return t.id_sets(rows).select("member", "root", "size")


@query("departed_vehicle", """WITH {D}, s AS (SELECT *, lag(type) OVER w AS p FROM d WHERE type IN ('parked', 'empty')
  WINDOW w AS (PARTITION BY site, level, spot ORDER BY ts, id)),
u AS (SELECT *, last_value(CASE WHEN type = 'parked' AND coalesce(p, 'empty') = 'empty' THEN id END IGNORE NULLS) OVER
  (PARTITION BY site, level, spot ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parked_id FROM s)
SELECT u.id, epoch_us(u.ts) AS ts, u.spot, u.sensor, parked_id, d.license, d.x, d.y FROM u JOIN d ON d.id = u.parked_id WHERE u.type = 'empty' AND p = 'parked'""")
def departed_vehicle(d):
    return t.departed_vehicle(d).select("id", us("ts"), "spot", "sensor", "parked_id", "license", "x", "y")


@query("latency_profile", """WITH {D}, l AS (SELECT sensor, CAST(floor(x * 10) AS BIGINT) AS ms FROM d)
SELECT sensor, count(*) AS count, round(avg(ms), 4) AS mean, round(stddev_samp(ms), 4) AS std, min(ms) AS min,
  round(quantile_cont(ms, 0.05), 4) AS p5, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, max(ms) AS max FROM l GROUP BY sensor""")
def latency_profile(d):
    out = t.latency_profile(d.withColumn("ms", F.floor(F.col("x") * 10)), "ms", "sensor")
    return out.select("sensor", "count", r4("mean"), r4("std"), "min", r4("p5"), r4("p50"), r4("p95"), "max")


@query("match_quality", f"""WITH {{D}}, {FRAMES}, {CAND},
a AS (SELECT id1, id2 FROM k QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY cost, id2) = 1),
b AS (SELECT id1, id2 FROM k QUALIFY row_number() OVER (PARTITION BY id2 ORDER BY cost, id1) = 1),
m AS (SELECT id1, id2, frame FROM k SEMI JOIN a USING (id1, id2) SEMI JOIN b USING (id1, id2))
SELECT frame, count(*) AS matches, CAST(count(*) FILTER (u.license <> v.license) AS BIGINT) AS errors
FROM m JOIN d u ON u.id = id1 JOIN d v ON v.id = id2 GROUP BY frame""")
def match_quality(d):
    found = _mutual(d)
    audit = t.match_audit(found.select(F.col("id1").alias("prev_id"), F.col("id2").alias("id"), "frame"), d)
    return t.match_quality(audit, "frame")


@query("match_frames")
def match_frames(d):
    return t.match_frames(_seen(d), NEAR, CARRY, FRAME, _cameras(d, 1, 0, 2)).select("prev_id", "id", r4("distance"))


@query("track_batch")
def tracked(d):
    blank = d.withColumn("license", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("license")))
    run = track_batch(blank, conflicts=_cameras(d, 1, 0, 2), cfg=CFG)
    return run.rows.select("id", "license", "object_id", "track_id", "prev_id", r4("heading"), "record_class")


@query("tracker_audit_points", f"""WITH {{D}} SELECT id, epoch_us(ts) // 1800000000 AS frame, CAST(CASE WHEN x > 100 THEN 1 ELSE 0 END AS BIGINT) AS ignored FROM d""")
def audit_points(d):
    return t.input_audit(d.where("x <= 100"), d.where("x > 100"), FRAME).select("id", "frame", F.col("ignored").cast("long"))
