"""Detections, spots and side tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotflow.schema import EVENT_SCHEMA

# How event kinds of the test tables stand for detection types.
TYPE_OF = {
    "signup": "entry",
    "purchase": "exit",
    "view": "moving",
    "click": "parked",
    "error": "empty",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as flat detections."""
    return as_detections(table(spark, sf_dir, "events"))


def as_detections(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(v) for kv in TYPE_OF.items() for v in kv])
    user = F.col("user_id")
    plate = F.concat(F.lit("V"), user)
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind[F.col("event_type")].alias("type"),
        plate.alias("license"),
        F.concat(F.lit("G"), user % 3).alias("site"),
        F.concat(F.lit("P"), 1 + user % 2).alias("level"),
        F.concat(F.lit("PS-"), user % 12).alias("spot"),
        F.concat(F.lit("C"), F.col("event_id") % 5).alias("sensor"),
        plate.alias("object_id"),
        F.col("value").alias("x"),
        k.alias("y"),
        F.when(F.col("event_id") % 3 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("http://cam/"), F.col("event_id")))
        .alias("video"),
    )


def spots(det: DataFrame) -> DataFrame:
    """The distinct spots seen in the detections."""
    return det.select("site", "level", "spot").distinct()


def nested(det: DataFrame) -> DataFrame:
    """Detections in the nested event shape."""
    at_spot = F.col("type").isin("parked", "empty")
    gate = F.col("type").isin("entry", "exit")
    point = F.struct(F.col("x"), F.col("y"), F.lit(0.0).alias("z"))
    built = det.select(
        F.col("id").cast("string").alias("messageid"),
        F.lit("1.0").alias("mdsversion"),
        F.col("ts").alias("@timestamp"),
        F.struct(
            F.col("site").alias("name"),
            F.when(gate, F.struct(F.col("level"), point.alias("coordinate"))).alias("entrance"),
            F.when(
                at_spot,
                F.struct(F.col("spot").alias("id"), F.col("level"), point.alias("coordinate")),
            ).alias("parkingSpot"),
            F.when(
                ~at_spot & ~gate, F.struct(F.col("level"), point.alias("coordinate"))
            ).alias("aisle"),
        ).alias("place"),
        F.struct(F.col("sensor").alias("id"), F.lit("Camera").alias("type")).alias("sensor"),
        F.struct(
            F.col("object_id").alias("id"),
            F.struct(F.col("license")).alias("vehicle"),
            point.alias("coordinate"),
        ).alias("object"),
        F.struct(F.col("id").cast("string").alias("id"), F.col("type")).alias("event"),
        F.col("video").alias("videoPath"),
    )
    return built


def wire(det: DataFrame) -> DataFrame:
    """Detections as (key, value) messages, value being event JSON."""
    return nested(det).select(
        F.col("messageid").alias("key"),
        F.to_json(
            F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}
        ).alias("value"),
    )


EVENT_FIELDS = [f.name for f in EVENT_SCHEMA.fields]
