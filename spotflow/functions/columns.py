"""Scalar column expressions: geometry, time, text. No UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 40000.0  # circumference used by the flat-earth conversion
EARTH_RADIUS_KM = 6371.0


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v) if isinstance(v, (int, float)) else F.col(v)


# -- planar and spherical geometry ------------------------------------------


def xy_to_lonlat(ox, oy, x, y, metres: bool = False) -> tuple[Column, Column]:
    """(lon, lat) of a point x, y away from the origin (km, or metres)."""
    unit = 0.001 if metres else 1.0
    lat = _c(oy) - _c(y) * unit * 360.0 / EARTH_KM
    lon = _c(ox) - _c(x) * unit * 360.0 / (
        EARTH_KM * F.cos((_c(oy) + lat) * math.pi / 360.0)
    )
    return lon, lat


def lonlat_to_xy(ox, oy, lon, lat) -> tuple[Column, Column]:
    """Flat-earth offset in km of (lon, lat) from the origin."""
    x = (_c(ox) - _c(lon)) * EARTH_KM * F.cos((_c(oy) + _c(lat)) * math.pi / 360.0) / 360.0
    return x, (_c(oy) - _c(lat)) * EARTH_KM / 360.0


def euclid(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy)


def angle_rad(x1, y1, x2, y2) -> Column:
    """Direction from point 1 to point 2 in [0, 2*pi)."""
    return F.pmod(F.atan2(_c(y2) - _c(y1), _c(x2) - _c(x1)), F.lit(2 * math.pi))


def angle_legacy(x1, y1, x2, y2) -> Column:
    """Slope angle by atan; a quarter turn where x does not change."""
    dx = _c(x1) - _c(x2)
    return F.when(F.abs(dx) < 1e-6, F.lit(math.pi / 2)).otherwise(
        F.atan((_c(y1) - _c(y2)) / dx)
    )


def great_circle_angle(lon1, lat1, lon2, lat2) -> Column:
    """Central angle in radians (haversine)."""
    f1, f2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((f2 - f1) / 2), 2) + F.cos(f1) * F.cos(f2) * F.pow(
        F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2
    )
    return 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def great_circle_km(lon1, lat1, lon2, lat2) -> Column:
    return great_circle_angle(lon1, lat1, lon2, lat2) * EARTH_RADIUS_KM


def great_circle_point(lon1, lat1, lon2, lat2, proportion) -> tuple[Column, Column]:
    """(lon, lat) at a proportion of the way along the great circle."""
    d = great_circle_angle(lon1, lat1, lon2, lat2)
    t = _c(proportion)
    wa = F.when(d == 0, 1 - t).otherwise(F.sin((1 - t) * d) / F.sin(d))
    wb = F.when(d == 0, t).otherwise(F.sin(t * d) / F.sin(d))
    f1, l1, f2, l2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    x = wa * F.cos(f1) * F.cos(l1) + wb * F.cos(f2) * F.cos(l2)
    y = wa * F.cos(f1) * F.sin(l1) + wb * F.cos(f2) * F.sin(l2)
    z = wa * F.sin(f1) + wb * F.sin(f2)
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def normalise(v, minimum: float = 0.0, extent: float = 1.0) -> Column:
    return (_c(v) - minimum) / float(extent)


def point_along(x1, y1, x2, y2, proportion) -> tuple[Column, Column]:
    p = F.least(F.greatest(_c(proportion), F.lit(0.0)), F.lit(1.0))
    return _c(x1) + (_c(x2) - _c(x1)) * p, _c(y1) + (_c(y2) - _c(y1)) * p


def project_on_segment(px, py, x1, y1, x2, y2) -> tuple[Column, Column, Column]:
    """(x, y, distance) of the point of a segment nearest to (px, py)."""
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    len2 = dx * dx + dy * dy
    t = ((_c(px) - _c(x1)) * dx + (_c(py) - _c(y1)) * dy) / len2
    qx, qy = point_along(x1, y1, x2, y2, F.when(len2 == 0, F.lit(0.0)).otherwise(t))
    return qx, qy, euclid(px, py, qx, qy)


def inside_polygon(px, py, ring: Column) -> Column:
    """True where (px, py) is strictly inside the ring (array<struct<x,y>>).

    Crossing count over the edges; a point on an edge or a vertex is outside.
    """
    px, py = _c(px), _c(py)
    n = F.size(ring)
    edges = F.zip_with(
        ring,
        F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)),
        lambda a, b: F.struct(
            a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")
        ),
    )

    def cross(e):
        return (e.x2 - e.x1) * (py - e.y1) - (px - e.x1) * (e.y2 - e.y1)

    on_edge = F.exists(
        edges,
        lambda e: (cross(e) == 0)
        & px.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
        & py.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)),
    )
    crossings = F.size(
        F.filter(
            edges,
            lambda e: ((e.y1 > py) != (e.y2 > py))
            & (px < (e.x2 - e.x1) * (py - e.y1) / (e.y2 - e.y1) + e.x1),
        )
    )
    return ~on_edge & (crossings % 2 == 1)


def camera_point(left, top, right, bottom) -> tuple[Column, Column]:
    """Centre x and lowest y of a bounding box in the camera frame."""
    return (_c(left) + _c(right)) / 2.0, F.greatest(_c(top), _c(bottom))


def cell(v, size: float) -> Column:
    """Index of the grid cell of a coordinate."""
    return F.floor(_c(v) / F.lit(float(size))).cast("long")


# -- time --------------------------------------------------------------------


def seconds_between(a, b) -> Column:
    return (F.unix_millis(_c(b)) - F.unix_millis(_c(a))) / 1000.0


def hours_between(a, b, now=None) -> Column:
    """Hours from a to b; an open end counts up to ``now`` where it is given."""
    end = F.coalesce(_c(b), _c(now)) if now is not None else _c(b)
    return (F.unix_millis(end) - F.unix_millis(_c(a))) / 3.6e6


def as_ts(value) -> Column:
    """A timestamp column from a column, a datetime or an ISO text."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def hours_ago(now, hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(as_ts(now)) - int(hours * 3_600_000_000))


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(text) -> Column:
    """Timestamp of an ISO text, null where it is none."""
    return F.try_to_timestamp(_c(text))


def local_to_utc(ts, zone: str) -> Column:
    return F.to_utc_timestamp(_c(ts), zone)


def range_bounds(text) -> tuple[Column, Column]:
    """The two timestamps of a ``[a TO b]`` text."""
    pattern = r"\[\s*(.*?)\s+TO\s+(.*?)\s*\]"
    return (
        parse_iso(F.regexp_extract(_c(text), pattern, 1)),
        parse_iso(F.regexp_extract(_c(text), pattern, 2)),
    )


# -- text --------------------------------------------------------------------


def two_places(v) -> Column:
    """A number rounded half up to two places, as text."""
    return F.round(_c(v), 2).cast("string")


def vehicle_key(plate) -> Column:
    return F.upper(F.trim(_c(plate)))


def safe_int(v) -> Column:
    return _c(v).try_cast("int")


def fingerprint(*cols) -> Column:
    """SHA-1 over the given columns, nulls included."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]))


def searchable(v) -> Column:
    """Lower-case words of a text, one space between and around them."""
    words = F.regexp_replace(F.lower(_c(v).cast("string")), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))
