"""Projections: parsing, repairing, renaming and rebuilding event rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spotflow.functions.columns import _c, two_places, vehicle_key
from spotflow.operators.ordered import SLICE, numbered
from spotflow.schema import EVENT_SCHEMA, WIRE_TIME


def repair_payload(value="value") -> Column:
    """The payload without the ill-typed ``used`` member some senders add."""
    return F.replace(_c(value), F.lit('"used" : "1",'), F.lit(""))


def parse_events(df: DataFrame, value: str = "value") -> DataFrame:
    """(…, JSON text) → nested event rows with a ``timestamp`` copy of the event time.

    Text that is no JSON, and members that are absent, give nulls.
    """
    parsed = F.from_json(repair_payload(value), EVENT_SCHEMA)
    return df.select(parsed.alias("_j")).select("_j.*").withColumn(
        "timestamp", F.col("`@timestamp`")
    )


def rewrite_media_url(df: DataFrame, old: str, new: str, col: str = "videoPath") -> DataFrame:
    """Replace a URL prefix; a missing path becomes the empty text."""
    return df.withColumn(col, F.coalesce(F.replace(F.col(col), F.lit(old), F.lit(new)), F.lit("")))


def to_detections(events: DataFrame) -> DataFrame:
    """Nested events → flat detections.

    The level is that of the spot for parked/empty rows, else that of the
    entrance, else that of the aisle.
    """
    spot_row = F.col("event.type").isin("parked", "empty")
    return events.select(
        F.col("messageid").alias("id"),
        F.col("`@timestamp`").alias("ts"),
        F.col("event.type").alias("type"),
        F.col("object.vehicle.license").alias("license"),
        F.col("place.name").alias("site"),
        F.when(spot_row, F.col("place.parkingSpot.level"))
        .otherwise(F.coalesce("place.entrance.level", "place.aisle.level"))
        .alias("level"),
        F.col("place.parkingSpot.id").alias("spot"),
        F.col("sensor.id").alias("sensor"),
        F.col("object.id").alias("object_id"),
        F.col("object.coordinate.x").alias("x"),
        F.col("object.coordinate.y").alias("y"),
        F.col("videoPath").alias("video"),
    )


def with_vehicle_key(df: DataFrame, plate: str = "license", name: str = "plate") -> DataFrame:
    return df.withColumn(name, vehicle_key(plate))


def qualify_object_id(df: DataFrame) -> DataFrame:
    """Object ids are unique per camera only: prefix them with the camera."""
    return df.withColumn(
        "object_id",
        F.when(
            F.col("sensor").isNotNull() & F.col("object_id").isNotNull(),
            F.concat(F.lit("^S"), "sensor", F.lit("_^O"), "object_id"),
        ).otherwise(F.col("object_id")),
    )


def default_plate(events: DataFrame) -> DataFrame:
    """Null plate and plate state become empty texts where there is a vehicle."""
    v = F.col("object.vehicle")
    filled = v.withField("license", F.coalesce(v.license, F.lit(""))).withField(
        "licenseState", F.coalesce(v.licenseState, F.lit(""))
    )
    return events.withColumn(
        "object",
        F.when(v.isNotNull(), F.col("object").withField("vehicle", filled)).otherwise(
            F.col("object")
        ),
    )


def upper_level(events: DataFrame) -> DataFrame:
    """Upper-case the level of aisle and spot."""
    out = F.col("place")
    for part in ("aisle", "parkingSpot"):
        sub = F.col(f"place.{part}")
        out = F.when(
            sub.isNotNull(), out.withField(part, sub.withField("level", F.upper(sub.level)))
        ).otherwise(out)
    return events.withColumn("place", out)


def normalise_spot_id(df: DataFrame) -> DataFrame:
    """Spot ids without ``PS`` get the form level-PS-id (parked and empty rows)."""
    bare = F.col("type").isin("parked", "empty") & ~F.col("spot").contains("PS")
    return df.withColumn(
        "spot",
        F.when(bare, F.concat_ws("-", "level", F.lit("PS"), "spot")).otherwise(F.col("spot")),
    )


def to_wire_json(df: DataFrame, cols: Iterable[str] | None = None) -> Column:
    """The row as JSON text, ``timestamp`` under its wire name, in ms."""
    names = list(cols or df.columns)
    rename = {"timestamp": "@timestamp"} if "@timestamp" not in names else {}
    return F.to_json(
        F.struct(*[F.col(f"`{n}`").alias(rename.get(n, n)) for n in names]),
        {"timestampFormat": WIRE_TIME},
    )


def encrypt_plate(plate, key: str, iv: str) -> Column:
    """AES-CBC of the plate in base64, without the leading IV; blank stays as it is."""
    p = _c(plate)
    cipher = F.aes_encrypt(
        F.encode(p, "UTF-8"), F.encode(F.lit(key), "UTF-8"), F.lit("CBC"), F.lit("PKCS"),
        F.encode(F.lit(iv), "UTF-8"),
    )
    body = F.substring(cipher, F.lit(17), F.length(cipher) - 16)
    return F.when(p.isNull() | (F.trim(p) == ""), p).otherwise(F.base64(body))


def decrypt_plate(text, key: str, iv: str) -> Column:
    t = _c(text)
    clear = F.aes_decrypt(
        F.concat(F.encode(F.lit(iv), "UTF-8"), F.unbase64(t)),
        F.encode(F.lit(key), "UTF-8"), F.lit("CBC"), F.lit("PKCS"),
    )
    return F.when(t.isNull() | (F.trim(t) == ""), t).otherwise(F.decode(clear, "UTF-8"))


def build_anomaly(
    df: DataFrame,
    kind: str,
    description: Column,
    start: str,
    end: str,
    timestamp: str | None = None,
    entry_video: Column | None = None,
    exit_video: Column | None = None,
    aisle_video: Column | None = None,
    module: str = "AM",
) -> DataFrame:
    """Rows in the anomaly shape: who, where, when, why, and the videos."""
    blank = F.lit("")
    return df.select(
        F.expr("uuid()").alias("messageid"),
        F.lit("1.0").alias("mdsversion"),
        F.col(timestamp or start).alias("timestamp"),
        F.col(start).alias("startTimestamp"),
        F.col(end).alias("endTimestamp"),
        F.struct(F.col("site").alias("name"), "level", "spot").alias("place"),
        F.struct(
            F.lit("1").alias("id"),
            description.alias("description"),
            F.lit(f"{module}-{kind}").alias("source"),
        ).alias("analyticsModule"),
        F.struct(
            F.col("object_id").alias("id"), F.struct(F.col("license")).alias("vehicle")
        ).alias("object"),
        F.struct(F.expr("uuid()").alias("id"), F.lit(kind).alias("type")).alias("event"),
        F.coalesce(entry_video if entry_video is not None else blank, blank).alias("entryVideo"),
        F.coalesce(exit_video if exit_video is not None else blank, blank).alias("exitVideo"),
        F.coalesce(aisle_video if aisle_video is not None else blank, blank).alias("aisleVideo"),
    )


def build_overstay(found: DataFrame, module: str = "AM") -> DataFrame:
    """Anomaly rows of :func:`~spotflow.operators.anomaly.overstay`; stamped at the end."""
    text = F.concat(F.lit("Overstay, "), two_places("hours"), F.lit(" hrs"))
    return build_anomaly(
        found, "Overstay", text, "start_ts", "end_ts", "end_ts",
        F.col("entry_video"), F.col("exit_video"), module=module,
    )


def build_understay(found: DataFrame, module: str = "AM") -> DataFrame:
    minutes = two_places((F.unix_millis("end_ts") - F.unix_millis("start_ts")) / 60000.0)
    return build_anomaly(
        found, "Understay", F.concat(F.lit("Short Stay "), minutes, F.lit(" minutes")),
        "start_ts", "end_ts", None, F.col("entry_video"), F.col("exit_video"), module=module,
    )


def build_stalled(found: DataFrame, module: str = "AM") -> DataFrame:
    seconds = two_places((F.unix_millis("end_ts") - F.unix_millis("start_ts")) / 1000.0)
    return build_anomaly(
        found, "UnexpectedStopping",
        F.concat(F.lit("Unexpected Stopping "), seconds, F.lit(" seconds")),
        "start_ts", "end_ts", aisle_video=F.col("video"), module=module,
    )


def build_list_anomaly(found: DataFrame, module: str = "AM") -> DataFrame:
    """Rows of :func:`~spotflow.operators.anomaly.list_anomaly` as anomalies."""
    out = None
    for kind in ("Whitelist", "Blacklist"):
        part = build_anomaly(
            found.where(F.col("list") == kind), kind, F.lit(f"this car is {kind}ed"), "ts", "ts",
            None,
            F.when(F.col("type") == "entry", F.col("video")),
            F.when(F.col("type") == "exit", F.col("video")),
            module=module,
        )
        out = part if out is None else out.unionByName(part)
    return out


def flatten_record(df: DataFrame, sep: str = "_") -> DataFrame:
    """Every leaf as one text column; null becomes '', and so does what is no text.

    Columns carry their full path, so equally named leaves do not collide.
    """
    out = []

    def walk(fields, path: list[str]):
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, here)
                continue
            name = sep.join(here)
            ref = ".".join(f"`{p}`" for p in here)
            text = isinstance(f.dataType, T.StringType)
            out.append((F.coalesce(F.col(ref), F.lit("")) if text else F.lit("")).alias(name))

    walk(df.schema.fields, [])
    return df.select(*out)


def strip_internal_fields(events: DataFrame) -> DataFrame:
    """Drop what the tracker adds to an event for its own use."""
    obj = events.schema["object"].dataType
    out = events.drop("traj")
    if "id_list" in obj.fieldNames():
        out = out.withColumn("object", F.col("object").dropFields("id_list"))
    if "coordinate" in obj.fieldNames() and "origPoints" in (
        obj["coordinate"].dataType.fieldNames()
    ):
        out = out.withColumn("object", F.col("object").dropFields("coordinate.origPoints"))
    return out


def topic_partition(*cols: str, partitions: int = 8) -> Column:
    """Which of the topic's partitions a message goes to."""
    return F.pmod(F.hash(*cols), F.lit(partitions)).cast("int")


def synthetic_vehicle(df: DataFrame, order: list[str], width: float = SLICE) -> DataFrame:
    """Give rows with an empty plate a made-up one, counted up per site and level.

    ``UNK-P-n`` for rows of a spot, ``UNK-M-n`` for the others; attributes UNKNOWN.
    """
    blank = F.coalesce(F.trim("license"), F.lit("")) == ""
    named = df.where(~blank).withColumn("synthetic", F.lit(False))
    numbers = numbered(df.where(blank), ["site", "level"], order, "_n", width=width)
    kind = F.when(F.col("type").isin("parked", "pulled", "empty"), "P").otherwise("M")
    made = (
        numbers.withColumn(
            "license",
            F.concat(F.lit("UNK-"), kind, F.lit("-"), (F.col("_n") - 1).cast("string")),
        )
        .withColumn("synthetic", F.lit(True))
        .drop("_n")
    )
    return named.unionByName(made)
