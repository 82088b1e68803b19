"""Entry and exit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotflow.functions.columns import as_ts

KINDS = ["entry", "exit"]


def _per_hour(count, window_s: int):
    factor = 3600 / window_s
    return count * (int(factor) if factor.is_integer() else F.lit(factor))


def flow_rate(df: DataFrame, window_s: int = 60, slide_s: int = 10) -> DataFrame:
    """Entries and exits per hour over sliding windows, by site, stamped at window end.

    Where the window is a multiple of the slide the rows are counted once per
    slide-sized pane and only these counts are spread over the windows that
    hold the pane, so the shuffle carries panes, not rows times windows.
    """
    rows = df.where(F.col("type").isin(*KINDS))
    if window_s % slide_s:
        win = F.window("ts", f"{window_s} seconds", f"{slide_s} seconds")
        counted = rows.groupBy(F.col("site").alias("id"), win.alias("w"), "type").count()
        counted = counted.withColumn("timestamp", F.col("w.end"))
    else:
        step = slide_s * 1_000_000
        pane = F.floor(F.unix_micros("ts") / step).cast("long")
        panes = rows.groupBy("site", "type", pane.alias("p")).agg(
            F.count(F.lit(1)).alias("n")
        )
        ends = F.sequence(F.col("p") + 1, F.col("p") + window_s // slide_s)
        counted = (
            panes.select("site", "type", "n", F.explode(ends).alias("e"))
            .groupBy(F.col("site").alias("id"), "type", "e")
            .agg(F.sum("n").alias("count"))
            .withColumn("timestamp", F.timestamp_micros(F.col("e") * step))
        )
    return counted.select("id", "timestamp", "type", _per_hour(F.col("count"), window_s).alias("count"))


def flow_rate_stream(df: DataFrame, window_s: int = 60, slide_s: int = 10,
                     watermark: str = "1 second") -> DataFrame:
    """The same on a stream: windows are emitted once the watermark has passed them."""
    win = F.window("ts", f"{window_s} seconds", f"{slide_s} seconds")
    return (
        df.where(F.col("type").isin(*KINDS))
        .withWatermark("ts", watermark)
        .groupBy(win.alias("w"), "type", F.col("site").alias("id"))
        .count()
        .select(
            "id", F.col("w.end").alias("timestamp"), "type",
            _per_hour(F.col("count"), window_s).alias("count"),
        )
    )


def flow_table(flow: DataFrame) -> DataFrame:
    """One row per site and window end, entry and exit as columns."""
    return flow.groupBy("id", "timestamp").pivot("type", KINDS).agg(F.first("count"))


def latest_flow(table: DataFrame, before=None, since=None) -> DataFrame:
    """Per site the newest row: ``since <= timestamp < before``; rates as 'N/hr'."""
    if before is not None:
        table = table.where(F.col("timestamp") < as_ts(before))
    if since is not None:
        table = table.where(F.col("timestamp") >= as_ts(since))
    newest = table.groupBy("id").agg(F.max_by(F.struct(*KINDS), "timestamp").alias("r"))
    return newest.select("id", *[hourly(F.col(f"r.{k}")).alias(k) for k in KINDS])


def hourly(rate):
    """'N/hr' text of a rate; none counts as 0."""
    return F.concat(F.coalesce(rate, F.lit(0)).cast("string"), F.lit("/hr"))
