"""Registry and the parts shared by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spotflow.sources import adapter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Detections as the adapter builds them.
D = """d AS (SELECT event_id AS id, ts,
  CASE event_type WHEN 'signup' THEN 'entry' WHEN 'purchase' THEN 'exit' WHEN 'view' THEN 'moving'
    WHEN 'click' THEN 'parked' WHEN 'error' THEN 'empty' END AS type,
  'V' || user_id AS license, 'G' || (user_id % 3) AS site, 'P' || (1 + user_id % 2) AS level,
  'PS-' || (user_id % 12) AS spot, 'C' || (event_id % 5) AS sensor, 'V' || user_id AS object_id,
  value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'http://cam/' || event_id END AS video
  FROM events)"""


def query(name: str, sql: str | None = None, over: str = "detections"):
    """Register ``f(detections)``, or ``f(spark, sf_dir)`` with over='tables'."""

    def add(f):
        if over == "tables":
            run = f
        else:
            def run(spark, sf_dir, _f=f):
                return _f(adapter.detections(spark, sf_dir))
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.replace("{D}", D)
        return f

    return add


def us(col: str, name: str | None = None) -> Column:
    """A time as microseconds since the epoch."""
    return F.unix_micros(col).alias(name or col)


def r4(col, name: str | None = None) -> Column:
    """Rounded to four places; no negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, 4) + F.lit(0.0)
    return out.alias(name or col) if (name or isinstance(col, str)) else out


def n(col: str, name: str | None = None) -> Column:
    return F.col(col).cast("long").alias(name or col)
