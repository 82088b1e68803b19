"""Search, newest-first feeds and monthly indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotflow.functions.columns import as_ts, fingerprint, searchable

FIELDS = ("type", "license", "site", "level", "spot", "sensor", "object_id", "video")


def _newest(df: DataFrame) -> list[Column]:
    return [F.desc("ts"), F.desc("id")]


def has_phrase(phrase: str, fields: Sequence[str]) -> Column:
    """True where the words of the phrase stand side by side in one of the fields."""
    wanted = searchable(F.lit(phrase))
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(searchable(f), wanted), F.lit(False))
    return found


def search(df: DataFrame, all_of: Sequence[str] = (), any_of: Sequence[str] = (),
           none_of: Sequence[str] = (), start=None, end=None,
           fields: Sequence[str] = FIELDS) -> DataFrame:
    """Rows with all, any and none of the given phrases, start <= ts <= end."""
    if start is not None:
        df = df.where(F.col("ts") >= as_ts(start))
    if end is not None:
        df = df.where(F.col("ts") <= as_ts(end))
    for p in all_of:
        df = df.where(has_phrase(p, fields))
    for p in none_of:
        df = df.where(~has_phrase(p, fields))
    if any_of:
        hit = F.lit(False)
        for p in any_of:
            hit = hit | has_phrase(p, fields)
        df = df.where(hit)
    return df


def recent(df: DataFrame, size: int) -> DataFrame:
    """The newest rows (top-k: each task keeps ``size`` rows)."""
    return df.orderBy(*_newest(df)).limit(size)


def event_hits(df: DataFrame) -> DataFrame:
    """What a search over events returns."""
    return df.select("id", "license", "ts", "level", "type", "video")


def alert_hits(df: DataFrame) -> DataFrame:
    """What a search over anomaly rows returns."""
    return df.select(
        F.col("messageid").alias("id"),
        F.col("object.vehicle.license").alias("license"),
        F.col("timestamp").alias("ts"),
        F.col("place.level").alias("level"),
        F.col("analyticsModule.description").alias("description"),
        F.col("entryVideo").alias("entry_video"),
        F.col("exitVideo").alias("exit_video"),
        F.col("endTimestamp").alias("end_ts"),
    )


def recent_events(df: DataFrame, size: int = 25, **query) -> DataFrame:
    return recent(event_hits(search(df, **query)), size)


def recent_alerts(alerts: DataFrame, size: int = 25, start=None, end=None,
                  all_of: Sequence[str] = ()) -> DataFrame:
    fields = ("license", "level", "description")
    return recent(search(alert_hits(alerts), all_of, start=start, end=end, fields=fields), size)


def compress_events(df: DataFrame, k: int = 2) -> DataFrame:
    """Of each plate's moving rows only the newest ``k``; all other rows stay.

    Rows without a plate are not grouped. The rank filter lets Spark cut each
    plate to ``k`` rows before the shuffle.
    """
    grouped = (F.col("type") == "moving") & (F.col("license") != "")
    rank = F.row_number().over(W.partitionBy("license").orderBy(*_newest(df)))
    newest = df.where(grouped).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
    return df.where(~F.coalesce(grouped, F.lit(False))).unionByName(newest)


def event_feed(df: DataFrame, scanned: int = 200, size: int = 25, k: int = 2, **query) -> DataFrame:
    """Newest rows, compressed, newest first."""
    return recent(compress_events(recent_events(df, scanned, **query), k), size)


def refill_panel(new: DataFrame, old: DataFrame, size: int = 20) -> DataFrame:
    """New hits, and where these are fewer than ``size`` the newest old ones after them."""
    place = F.row_number().over(W.orderBy(*_newest(old)))
    room = F.lit(size) - new.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = recent(old, size).withColumn("_p", place).where(F.col("_p") <= room).drop("_p")
    return new.withColumn("is_new", F.lit(True)).unionByName(
        kept.withColumn("is_new", F.lit(False))
    )


def monthly(df: DataFrame, kind: str, ts: str = "ts") -> DataFrame:
    """Index columns: type, year, month of the event time."""
    return df.select(
        "*", F.lit(kind).alias("index_type"),
        F.year(ts).alias("year"), F.month(ts).alias("month"),
    )


def distinct_anomalies(df: DataFrame, ts: str = "ts", kind: str = "type",
                       who: str = "license") -> DataFrame:
    """One row per fingerprint of (time, type, vehicle): of re-sent anomalies the last by time and id stays."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rank = F.struct(ts, *[c for c in ("id",) if c in df.columns])
    marked = df.withColumn("fingerprint", fingerprint(text, kind, who))
    return marked.groupBy("fingerprint").agg(F.max_by(F.struct(*df.columns), rank).alias("_r")).select("_r.*", "fingerprint")
