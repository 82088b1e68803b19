"""The tracker on a stream: every micro-batch goes on where the last one stopped.

What is carried over are tables: the newest frame of each site and level, and
younger rows without a partner, with their labels; and the sets of object ids known
to be one vehicle. A frame is matched only when
the newest time seen has left it behind by ``delay_s``; until then its rows are
held back, so it does not matter where a trigger cuts. Rows of frames that are
done already go to a table of late rows. Each batch reads the state its
predecessor wrote and writes its own, so a batch that is repeated after a
failure finds the same input and replaces its own output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from spotflow.operators import known_ids, tracking as tr
from spotflow.plans.tracking import TrackerConfig, prepare, spot_pass_through
from spotflow.sources import writers
from spotflow.streaming.jobs import StreamRun

CLOCK = "batch long, newest long, bound long"


def _part(spark: SparkSession, path: str, batch: int, schema=None) -> DataFrame | None:
    """What one batch left in a table; none if it left nothing."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(f"{path}/batch={batch}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass
class StreamTracker:
    """Holds the tracker's tables and parameters; :meth:`step` handles one micro-batch."""

    tables: str
    cfg: TrackerConfig = field(default_factory=TrackerConfig)
    regions: DataFrame | None = None
    lines: DataFrame | None = None
    conflicts: DataFrame | None = None
    overlaps: DataFrame | None = None
    delay_s: float = 0.0

    def _clock(self, spark: SparkSession, before: int | None = None) -> tuple[int, int, int] | None:
        """(batch, newest time, first frame not done) of the last batch, or of the last before one."""
        if before is not None and (one := _part(spark, f"{self.tables}/clock", before - 1)) is not None:
            return (before - 1, *one.first()[:2])
        try:
            table = spark.read.schema(CLOCK).parquet(f"{self.tables}/clock")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        rows = table if before is None else table.where(F.col("batch") < before)
        last = rows.agg(F.max(F.struct("batch", "newest", "bound"))).first()[0]
        return None if last is None else tuple(last)

    def step(self, batch: DataFrame, number: int, last: bool = False) -> None:
        """One micro-batch; ``last`` also does the frames that would be held back."""
        spark, cfg = batch.sparkSession, self.cfg
        clock = self._clock(spark, number)
        ready = prepare(batch, self.regions, self.lines, cfg)
        carried = made = sets = None
        if clock is not None:
            carried, made, sets = (_part(spark, f"{self.tables}/{name}", clock[0]) for name in ("open", "made", "sets"))
            held = _part(spark, f"{self.tables}/held", clock[0], ready.schema)
            ready = ready if held is None else ready.unionByName(held)
        ready = tr.cut(ready)
        seen = ready.agg(F.max(F.unix_micros("ts"))).first()[0]
        known = [v for v in (seen, clock and clock[1]) if v is not None]
        if not known:
            return
        newest, done = max(known), clock[2] if clock else None
        bound = (newest - int(self.delay_s * 1e6)) // int(cfg.frame_s * 1e6)
        bound = max(b for b in (bound, done) if b is not None)
        if done is not None:
            writers.write_table(ready.where(F.col("frame") < done), f"{self.tables}/late", number)
            ready = ready.where(F.col("frame") >= done)
        if not last:
            writers.write_table(ready.where(F.col("frame") >= bound), f"{self.tables}/held", number)
            ready = ready.where(F.col("frame") < bound)
        moving = tr.collapse_frame(ready.where(F.col("record_class") == "moving"))
        clustered, sets = known_ids.cluster_known(
            tr.cut(moving), cfg.cluster_d, self.conflicts, self.overlaps, sets, cfg.known_s, cfg.frame_s
        )
        merged = tr.cut(tr.cluster_output(tr.cut(clustered)).drop("cluster"))
        pairs = tr.match_frames(
            merged, cfg.match_d, cfg.carry_s, cfg.frame_s, self.conflicts, cfg.slice_s, carried
        )
        labelled = tr.cut(tr.label_tracks(merged, pairs, cfg.slice_s, carried, made))
        out = labelled.unionByName(spot_pass_through(ready), allowMissingColumns=True)
        writers.write_table(out.drop("ids"), f"{self.tables}/tracked", number)
        if last:  # what follows a restart replaces this batch
            return
        writers.write_table(self._open(labelled, carried, pairs), f"{self.tables}/open", number)
        writers.write_table(self._made(labelled, made), f"{self.tables}/made", number)
        done_us = bound * int(cfg.frame_s * 1e6)  # no frame before this one comes
        writers.write_table(known_ids.live(sets, done_us, cfg.known_s), f"{self.tables}/sets", number)
        writers.write_table(spark.createDataFrame([(newest, bound)], "newest long, bound long"), f"{self.tables}/clock", number)

    def finish(self, batch: DataFrame) -> None:
        """Do the frames held back, as the batch that would come next; ``batch`` is an empty one.

        If the stream goes on later, its next batch takes this one's place.
        """
        clock = self._clock(batch.sparkSession)
        if clock is not None:
            self.step(batch, clock[0] + 1, last=True)

    def _open(self, labelled: DataFrame, carried: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """Rows the next batch may go on from; places without news keep theirs."""
        newest = labelled.groupBy(*tr.PLACE).agg(F.max("frame").alias("_frame"))
        at = (
            labelled.join(newest, tr.PLACE).where(F.col("frame") == F.col("_frame"))
            .groupBy(*tr.PLACE).agg(F.first("_frame").alias("_frame"), F.min("ts").alias("_at"))
        )
        rows = labelled.withColumn("_new", F.lit(True))
        if carried is not None:
            rows = rows.unionByName(carried.withColumn("_new", F.lit(False)))
        unmatched = rows.join(pairs.select(F.col("prev_id").alias("id")), "id", "left_anti")
        young = F.unix_micros("_at") - F.unix_micros("ts") <= int(self.cfg.carry_s * 1e6)
        stays = F.col("_at").isNull() | (F.col("_new") & (F.col("frame") == F.col("_frame"))) | young
        kept = unmatched.join(at, tr.PLACE, "left").where(stays)
        return kept.select(*labelled.columns)

    def _made(self, labelled: DataFrame, made: DataFrame | None) -> DataFrame:
        fresh = labelled.where("synthetic").groupBy(*tr.PLACE).agg(F.count(F.lit(1)).alias("made"))
        both = fresh if made is None else fresh.unionByName(made)
        return both.groupBy(*tr.PLACE).agg(F.sum("made").alias("made"))


class _Drained:
    """A query that works off what is there; once it is done, so are the frames held back."""

    def __init__(self, query: StreamingQuery, tracker: StreamTracker, empty: DataFrame):
        self._query, self._tracker, self._empty = query, tracker, empty

    def __getattr__(self, name: str):
        return getattr(self._query, name)

    def awaitTermination(self) -> None:
        self._query.awaitTermination()
        self._tracker.finish(self._empty)


def start_tracker(run: StreamRun, det: DataFrame, tracker: StreamTracker) -> StreamingQuery | _Drained:
    """Follow vehicles on a stream of detections; tables under ``tracker.tables``."""
    query = run.start(det, "tracker", tracker.step)
    return _Drained(query, tracker, det.sparkSession.createDataFrame([], det.schema)) if run.drain else query
