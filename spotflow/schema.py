"""Schemas of detection events and of the flat rows the operators work on.

A *nested event* has the wire shape (place, sensor, object, event sub-structs).
A *detection* is its flat form: the columns the operators need, under short
names, so that a parquet scan reads only those leaves.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _DBL = T.StringType(), T.DoubleType()


def _struct(*fields) -> T.StructType:
    """A struct of (names, type) groups; names are space separated."""
    return T.StructType(
        [T.StructField(n, t) for names, t in fields for n in names.split()]
    )


POINT = _struct(("x y z", _DBL))
LOCATION = _struct(("lat lon alt", _DBL))
PLACE = _struct(
    ("id name type", _STR),
    ("location", LOCATION),
    ("entrance", _struct(("name lane level", _STR), ("coordinate", POINT))),
    ("parkingSpot", _struct(("id type level", _STR), ("coordinate", POINT))),
    ("aisle", _struct(("id name level", _STR), ("coordinate", POINT))),
)
SENSOR = _struct(
    ("id type", _STR), ("location", LOCATION), ("description", _STR), ("coordinate", POINT)
)
MODULE = _struct(("id description source version", _STR))
VEHICLE = _struct(
    ("type license licenseState color", _STR), ("confidence", _DBL), ("model make", _STR)
)
OBJECT = _struct(
    ("id", _STR),
    ("vehicle", VEHICLE),
    ("bbox", _struct(("topleftx toplefty bottomrightx bottomrighty", _DBL))),
    ("signature", T.ArrayType(_DBL)),
    ("speed direction orientation", _DBL),
    ("location", LOCATION),
    ("coordinate", POINT),
)
EVENT = _struct(("id type source email", _STR))

EVENT_SCHEMA = _struct(
    ("messageid mdsversion", _STR),
    ("@timestamp", T.TimestampType()),
    ("used", T.IntegerType()),
    ("place", PLACE),
    ("sensor", SENSOR),
    ("analyticsModule", MODULE),
    ("object", OBJECT),
    ("event", EVENT),
    ("videoPath", _STR),
)

# The event types a valid detection may carry.
EVENT_TYPES = ("entry", "exit", "moving", "stopped", "parked", "empty", "reset")
# Plates that do not identify a vehicle.
UNIDENTIFIED = ("UNKNOWN", "", "DGDGCOM")
# Fixed value: timestamps on the wire.
WIRE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

DETECTION = _struct(
    ("id", _STR),
    ("ts", T.TimestampType()),
    ("type license site level spot sensor object_id", _STR),
    ("x y", _DBL),
    ("video", _STR),
)
