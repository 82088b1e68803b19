"""Sources, projections, filters, record classes and column functions."""

from pyspark.sql import functions as F

from spotflow.catalog.base import query, r4, us
from spotflow.functions import columns as c
from spotflow.operators import projections as p, quality as q
from spotflow.sources import adapter, readers

ROWS = "id, epoch_us(ts) AS ts, type, license, site, level"


def _rows(df):
    return df.select("id", us("ts"), "type", "license", "site", "level")


@query("read_events", "WITH {D} SELECT " + ROWS + " FROM d")
def read_events(d):
    return _rows(d)


def _lines(d):
    return adapter.wire(d).select("value")


@query("read_detection_lines", """WITH {D} SELECT CAST(id AS VARCHAR) AS id, (epoch_us(ts) // 1000) AS ts_ms, type, license, x, y FROM d
WHERE (epoch_us(ts) // 1000) >= (epoch_us(TIMESTAMP '2024-01-05 00:00:00') // 1000) AND (epoch_us(ts) // 1000) < (epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000)""")
def detection_lines(d):
    out = readers.detection_lines(_lines(d), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return p.to_detections(out).select("id", F.unix_millis("ts").alias("ts_ms"), "type", "license", "x", "y")


@query("parse_events", """WITH {D} SELECT CAST(id AS VARCHAR) AS id, (epoch_us(ts) // 1000) AS ts_ms, type, license, site, level,
  CASE WHEN type IN ('parked', 'empty') THEN spot END AS spot, sensor, object_id, x, y, video FROM d""")
def parse_events(d):
    return p.to_detections(p.parse_events(_lines(d))).select(
        "id", F.unix_millis("ts").alias("ts_ms"), "type", "license", "site", "level", "spot", "sensor",
        "object_id", "x", "y", "video")


@query("repair_payload", """WITH {D} SELECT CAST(id AS VARCHAR) AS id, type FROM d""")
def repair_payload(d):
    broken = _lines(d).select(F.replace("value", F.lit('{"messageid"'), F.lit('{"used" : "1","messageid"')).alias("value"))
    return p.to_detections(p.parse_events(broken)).select("id", "type")


@query("rewrite_media_url", """WITH {D} SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE replace(video, 'http://cam', 'https://media') END AS video FROM d""")
def rewrite_media_url(d):
    some = d.select("id", F.when(F.col("id") % 4 != 0, F.col("video")).alias("video"))
    return p.rewrite_media_url(some, "http://cam", "https://media", "video")


@query("vehicle_key", "WITH {D} SELECT id, upper(trim(' ' || lower(license) || ' ')) AS plate FROM d")
def vehicle_key(d):
    raw = d.withColumn("license", F.concat(F.lit(" "), F.lower("license"), F.lit(" ")))
    return p.with_vehicle_key(raw).select("id", "plate")


@query("qualify_object_id", "WITH {D} SELECT id, '^S' || sensor || '_^O' || object_id AS object_id FROM d")
def qualify_object_id(d):
    return p.qualify_object_id(d).select("id", "object_id")


@query("default_plate", """WITH {D} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 4 = 0 THEN '' ELSE license END AS license FROM d""")
def default_plate(d):
    some = d.withColumn("license", F.when(F.col("id") % 4 != 0, F.col("license")))
    parsed = p.parse_events(_lines(some))
    return p.default_plate(parsed).select(F.col("messageid").alias("id"), F.col("object.vehicle.license").alias("license"))


@query("upper_level", """WITH {D} SELECT CAST(id AS VARCHAR) AS id,
  CASE WHEN type = 'moving' THEN level END AS aisle_level, CASE WHEN type IN ('parked', 'empty') THEN level END AS spot_level FROM d""")
def upper_level(d):
    low = p.parse_events(_lines(d.withColumn("level", F.lower("level"))))
    return p.upper_level(low).select(
        F.col("messageid").alias("id"), F.col("place.aisle.level").alias("aisle_level"),
        F.col("place.parkingSpot.level").alias("spot_level"))


@query("normalise_spot_id", """WITH {D} SELECT id, CASE WHEN type NOT IN ('parked', 'empty') THEN spot[4:]
  ELSE level || '-PS-' || spot[4:] END AS spot FROM d""")
def normalise_spot_id(d):
    bare = d.withColumn("spot", F.expr("substring(spot, 4)"))
    return p.normalise_spot_id(bare).select("id", "spot")


@query("to_wire_json", """WITH {D} SELECT id, '{"id":' || id || ',"@timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
  || '","type":"' || type || '"}' AS json FROM d""")
def to_wire_json(d):
    rows = d.select("id", F.col("ts").alias("timestamp"), "type")
    return rows.select("id", p.to_wire_json(rows).alias("json"))


KEY, IV = "0123456789abcdef0123456789abcdef", "fedcba9876543210"  # for the round trip only


@query("decrypt_plate", "WITH {D} SELECT id, license, true AS hidden FROM d")
def decrypt_plate(d):
    hidden = d.withColumn("hidden", p.encrypt_plate("license", KEY, IV))
    return hidden.select(
        "id", p.decrypt_plate("hidden", KEY, IV).alias("license"),
        (F.col("hidden") != F.col("license")).alias("hidden"))


@query("encrypt_plate", """WITH {D} SELECT id, CAST(4 * ceil(16 * (strlen(license) // 16 + 1) / 3.0) AS BIGINT) AS length, true AS base64,
  dense_rank() OVER (ORDER BY license) = dense_rank() OVER (ORDER BY license) AS one_form FROM d""")
def encrypt_plate(d):
    """What can be said without the cipher: whole blocks, base64, one form for each plate and no two alike."""
    hidden = d.select("id", "license", p.encrypt_plate("license", KEY, IV).alias("hidden"))
    forms = hidden.groupBy("license").agg(F.countDistinct("hidden").alias("forms"), F.min("hidden").alias("_h"))
    owners = forms.groupBy("_h").agg(F.count(F.lit(1)).alias("plates"))
    known = forms.join(owners, "_h").select("license", ((F.col("forms") == 1) & (F.col("plates") == 1)).alias("one_form"))
    return hidden.join(known, "license").select(
        "id", F.length("hidden").cast("long").alias("length"), F.col("hidden").rlike("^[A-Za-z0-9+/]+=*$").alias("base64"), "one_form")


@query("topic_partition", """WITH {D} SELECT type || '/' || license AS "key", CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS parts, true AS in_range
FROM d GROUP BY ALL""")
def topic_partition(d):
    """Every key goes to one partition of the eight."""
    part = p.topic_partition("type", "license")
    return d.groupBy(F.concat_ws("/", "type", "license").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(part).alias("parts"), F.every(part.between(0, 7)).alias("in_range"))


@query("synthetic_vehicle", """WITH {D}, b AS (SELECT *, id % 4 = 0 AS s FROM d)
SELECT id, s AS synthetic, CASE WHEN NOT s THEN license ELSE 'UNK-' || CASE WHEN type IN ('parked', 'empty') THEN 'P' ELSE 'M' END || '-'
  || (row_number() OVER (PARTITION BY site, level, s ORDER BY ts, id) - 1) END AS license FROM b""")
def synthetic_vehicle(d):
    some = d.withColumn("license", F.when(F.col("id") % 4 != 0, F.col("license")).otherwise(""))
    return p.synthetic_vehicle(some, ["ts", "id"]).select("id", "synthetic", "license")


@query("flatten_record", """WITH {D} SELECT CAST(id AS VARCHAR) AS messageid, '' AS "@timestamp", site AS place_name,
  CASE WHEN type IN ('parked', 'empty') THEN spot ELSE '' END AS "place_parkingSpot_id", sensor AS sensor_id,
  '' AS object_coordinate_x, license AS object_vehicle_license, type AS event_type FROM d""")
def flatten_record(d):
    return p.flatten_record(adapter.nested(d)).select(
        "messageid", "`@timestamp`", "place_name", "place_parkingSpot_id", "sensor_id", "object_coordinate_x",
        "object_vehicle_license", "event_type")


@query("strip_internal_fields", "WITH {D} SELECT CAST(id AS VARCHAR) AS id, 'id,vehicle,coordinate' AS fields, x FROM d")
def strip_internal_fields(d):
    marked = adapter.nested(d).withColumn("traj", F.lit(1)).withColumn(
        "object", F.col("object").withField("id_list", F.array("object.id")).withField(
            "coordinate.origPoints", F.array(F.col("object.coordinate"))))
    out = p.strip_internal_fields(marked)
    names = ",".join(out.schema["object"].dataType.fieldNames())
    return out.select(F.col("messageid").alias("id"), F.lit(names).alias("fields"), F.col("object.coordinate.x").alias("x"))


# -- filters -----------------------------------------------------------------------------

@query("by_event_type", "WITH {D} SELECT " + ROWS + " FROM d WHERE type NOT IN ('parked', 'empty')")
def by_event_type(d):
    return _rows(q.by_event_type(d, "parked", "empty", exclude=True))


ODD_PLATE = "CASE WHEN id % 5 = 0 THEN ' unknown ' WHEN id % 5 = 1 THEN '' WHEN id % 5 = 2 THEN NULL ELSE license END"


@query("identified_only", f"WITH {{D}} SELECT id, license FROM (SELECT id, {ODD_PLATE} AS license FROM d) WHERE id % 5 > 2")
def identified_only(d):
    return q.identified_only(d.withColumn("license", F.expr(ODD_PLATE))).select("id", "license")


@query("drop_bad_timestamps", """WITH {D} SELECT id, (epoch_us(ts) // 1000) AS ts_ms FROM d WHERE id % 6 NOT IN (0, 1)""")
def drop_bad_timestamps(d):
    text = F.when(F.col("id") % 6 == 0, "yesterday").when(F.col("id") % 6 != 1, c.iso_text("ts"))
    rows = d.select("id", text.alias("text"))
    return q.drop_bad_timestamps(rows, "text").select("id", F.unix_millis("ts").alias("ts_ms"))


@query("in_time_range", "WITH {D} SELECT " + ROWS + " FROM d WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
def in_time_range(d):
    return _rows(q.in_time_range(d, "2024-01-05", "2024-01-07"))


@query("drop_reset", """WITH {D} SELECT id, type FROM d WHERE id % 4 NOT IN (0, 1)""")
def drop_reset(d):
    kind = F.when(F.col("id") % 4 == 0, "reset").when(F.col("id") % 4 != 1, F.col("type"))
    return q.drop_reset(d.withColumn("type", kind)).select("id", "type")


@query("since_hours_ago", "WITH {D} SELECT " + ROWS + " FROM d WHERE ts > TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 24 HOUR")
def since_hours_ago(d):
    return _rows(q.since_hours_ago(d, 24, "2024-01-29 00:00:00"))


@query("record_flags", """WITH {D}, p AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'pulled' WHEN id % 9 = 1 THEN 'stopped' ELSE type END AS t FROM d)
SELECT id, t IN ('parked', 'pulled', 'empty') AS is_spot, t = 'parked' AS is_parked, t = 'empty' AS is_empty,
  t = 'pulled' AS is_pulled, t IN ('entry', 'exit', 'moving', 'stopped') AS is_aisle FROM p""")
def record_flags(d):
    return q.with_record_flags(_odd_types(d)).select("id", "is_spot", "is_parked", "is_empty", "is_pulled", "is_aisle")


def _odd_types(d):
    odd = F.when(F.col("id") % 9 == 0, "pulled").when(F.col("id") % 9 == 1, "stopped")
    return d.withColumn("type", F.coalesce(odd, F.col("type")))


@query("classify_records", """WITH {D} SELECT id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN 'moving' WHEN type = 'parked' THEN 'parked'
  WHEN type = 'empty' THEN 'emptySpots' ELSE 'moving' END AS record_class FROM d""")
def classify_records(d):
    return q.classify_records(_odd_types(d)).select("id", "record_class")


# -- quality ---------------------------------------------------------------------------------

@query("validate_events", """WITH {D} SELECT CAST(id AS VARCHAR) AS key, (id % 7 NOT IN (0, 1, 2)) AS flag, CASE id % 7
  WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'event.type: not one of the known values'
  WHEN 2 THEN 'place: missing' || chr(10) || 'object.coordinate.x: not of type number/null' ELSE '' END AS message FROM d""")
def validate_events(d):
    kind = F.pmod(F.col("key").cast("long"), F.lit(7))
    bad = (
        F.when(kind == 0, F.concat(F.lit("["), F.col("value")))
        .when(kind == 1, F.regexp_replace("value", '"type":"(entry|exit|moving|parked|empty)"', '"type":"flying"'))
        .when(kind == 2, F.replace(F.regexp_replace("value", '"x":[-0-9.]+', '"x":"far"'), F.lit('"place":'), F.lit('"plaza":')))
        .otherwise(F.col("value"))
    )
    return q.validate_events(adapter.wire(d).withColumn("value", bad)).select("key", "flag", "message")


@query("report_invalid", """WITH {D} SELECT CAST(id AS VARCHAR) AS key FROM d WHERE id % 7 = 0""")
def report_invalid(d):
    cutoff = F.when(F.col("key").cast("long") % 7 == 0, F.expr("left(value, 20)")).otherwise(F.col("value"))
    return q.invalid_events(adapter.wire(d).withColumn("value", cutoff)).select("key")


# -- column functions ----------------------------------------------------------------------------

@query("xy_to_lonlat", """WITH {D}, g AS (SELECT id, x, y, 37.28728 - y * 0.001 * 360 / 40000 AS lat FROM d),
h AS (SELECT *, -121.9850525 - x * 0.001 * 360 / (40000 * cos((37.28728 + lat) * pi() / 360)) AS lon FROM g)
SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat, round((-121.9850525 - lon) * 40000000 * cos((37.28728 + lat) * pi() / 360) / 360, 3) AS bx,
  round((37.28728 - lat) * 40000000 / 360, 3) AS by FROM h""")
def xy_to_lonlat(d):
    lon, lat = c.xy_to_lonlat(-121.9850525, 37.28728, "x", "y", metres=True)
    g = d.select("id", lon.alias("lon"), lat.alias("lat"))
    bx, by = c.lonlat_to_xy(-121.9850525, 37.28728, "lon", "lat")
    return g.select("id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"),
                    F.round(bx * 1000, 3).alias("bx"), F.round(by * 1000, 3).alias("by"))


@query("planar_angles", """WITH {D} SELECT id, round(sqrt(pow(x - 50, 2) + pow(y - 50, 2)), 4) AS dist,
  round(CASE WHEN atan2(y - 50, x - 50) < 0 THEN atan2(y - 50, x - 50) + 2 * pi() ELSE atan2(y - 50, x - 50) END, 4) AS angle,
  round(CASE WHEN abs(50 - x) < 1e-6 THEN pi() / 2 ELSE atan((50 - y) / (50 - x)) END, 4) + 0.0 AS slope,
  round((x - 5) / 200.0, 7) AS nx, round(50 + (x - 50) * 0.25, 7) AS px, round(50 + (y - 50) * 0.25, 7) AS py FROM d""")
def planar_angles(d):
    o = F.lit(50.0)
    px, py = c.point_along(o, o, "x", "y", 0.25)
    return d.select(
        "id", r4(c.euclid(o, o, "x", "y"), "dist"), r4(c.angle_rad(o, o, "x", "y"), "angle"),
        r4(c.angle_legacy(o, o, "x", "y"), "slope"), F.round(c.normalise("x", 5, 200), 7).alias("nx"),
        F.round(px, 7).alias("px"), F.round(py, 7).alias("py"))


@query("great_circle", """WITH {D}, g AS (SELECT id, radians(x / 10) AS a, radians(y / 10) AS b FROM d),
h AS (SELECT id, a, b, 2 * asin(sqrt(least(pow(sin(b / 2), 2) + cos(b) * pow(sin(a / 2), 2), 1))) AS w FROM g)
SELECT id, round(w * 6371, 4) AS km, round(w, 6) AS angle FROM h""")
def great_circle(d):
    zero = F.lit(0.0)
    at = (zero, zero, F.col("x") / 10, F.col("y") / 10)
    return d.select("id", r4(c.great_circle_km(*at), "km"), F.round(c.great_circle_angle(*at), 6).alias("angle"))


@query("great_circle_point", """WITH {D} SELECT id, round(x / 20, 4) AS lon, CAST(0 AS DOUBLE) AS lat FROM d""")
def great_circle_point(d):
    zero = F.lit(0.0)
    lon, lat = c.great_circle_point(zero, zero, F.col("x") / 10, zero, 0.5)
    return d.select("id", r4(lon, "lon"), r4(lat, "lat"))


@query("hours_between", """WITH {D} SELECT id, ((epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ts) // 1000 + 180) // 360) / 10000.0 AS hours,
  CAST(((epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ts) // 1000 + 18000) // 36000) / 100.0 AS VARCHAR) AS text,
  year(ts) AS year, month(ts) AS month, sha1(strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')) AS mark,
  epoch_us(ts + INTERVAL 8 HOUR) AS utc FROM d""")
def hours_between(d):
    h = c.hours_between("ts", F.lit(None).cast("timestamp"), now=F.lit("2024-02-01").cast("timestamp"))
    return d.select(
        "id", r4(h, "hours"), c.two_places(h).alias("text"), F.year("ts").cast("long").alias("year"),
        F.month("ts").cast("long").alias("month"), c.fingerprint(c.iso_text("ts")).alias("mark"),
        F.unix_micros(c.local_to_utc("ts", "America/Los_Angeles")).alias("utc"))


@query("range_bounds", """WITH {D} SELECT id, (epoch_us(ts) // 1000) AS from_ms, (epoch_us(ts) // 1000) + 3600000 AS to_ms, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS num FROM d""")
def range_bounds(d):
    text = F.concat(F.lit("@timestamp:["), c.iso_text("ts"), F.lit(" TO "),
                    F.date_format(F.col("ts") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("]"))
    num = F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id").cast("string"))
    rows = d.select("id", text.alias("t"), num.alias("num"))
    a, b = c.range_bounds("t")
    return rows.select("id", F.unix_millis(a).alias("from_ms"), F.unix_millis(b).alias("to_ms"), c.safe_int("num").cast("long").alias("num"))


@query("camera_point", "WITH {D} SELECT id, (x + (x + 2)) / 2 AS cx, y + 5 AS cy FROM d")
def camera_point(d):
    cx, cy = c.camera_point("x", F.col("y") + 5, F.col("x") + 2, "y")
    return d.select("id", cx.alias("cx"), cy.alias("cy"))


@query("in_map_bounds", "WITH {D} SELECT id FROM d WHERE x BETWEEN 10 AND 40 AND y BETWEEN 20 AND 60")
def in_map_bounds(d):
    return q.in_map_bounds(d.select("id", F.col("x").alias("lon"), F.col("y").alias("lat")), 20, 10, 60, 40).select("id")


@query("site_origin", "WITH {D} SELECT site, round(avg(x), 4) AS lon, round(avg(y), 4) AS lat FROM d GROUP BY site")
def site_origin(d):
    return d.groupBy("site").agg(r4(F.avg("x"), "lon"), r4(F.avg("y"), "lat"))
