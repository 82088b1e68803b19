"""Starting the streaming queries. Each has its own checkpoint under one root."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spotflow.operators import projections as p
from spotflow.operators.anomaly import list_anomaly
from spotflow.operators.flow import flow_rate_stream
from spotflow.operators.quality import invalid_events
from spotflow.sources import writers
from spotflow.streaming import state

# Trigger intervals of the queries.
EVERY = {
    "understay": "60 seconds", "stalled": "30 seconds", "valid_tracks": "3 seconds",
    "invalid": "60 seconds", "scene": "0.5 seconds", "tracker": "0.5 seconds",
}


@dataclass(frozen=True)
class StreamRun:
    """Where the queries of a run keep checkpoints and tables, and how they are triggered.

    ``drain`` works off what is there and stops; else the intervals above apply.
    """

    checkpoints: str
    tables: str
    drain: bool = False

    def start(self, df: DataFrame, name: str, sink: Callable[[DataFrame, int], None] | None = None,
              mode: str = "append") -> StreamingQuery:
        """Run ``sink`` on every batch, or append the rows to a table named after the query."""
        writer = df.writeStream.queryName(name).outputMode(mode)
        writer = writer.option("checkpointLocation", f"{self.checkpoints}/{name}")
        if self.drain:
            writer = writer.trigger(availableNow=True)
        elif name in EVERY:
            writer = writer.trigger(processingTime=EVERY[name])
        if sink is None:
            return writer.format("parquet").option("path", f"{self.tables}/{name}").start()
        return writer.foreachBatch(sink).start()


def start_state_tables(run: StreamRun, det: DataFrame) -> StreamingQuery:
    """Spot state, spot history and aisle table from one read of the stream."""

    def fan_out(batch: DataFrame, number: int) -> None:
        rows = batch.where("type <> 'reset'").persist()
        try:
            writers.upsert_spot_state(rows, f"{run.tables}/spot_state", number)
            writers.append_spot_history(
                rows, f"{run.tables}/spot_history", number, f"{run.tables}/spot_rejected"
            )
            writers.append_aisle(rows, f"{run.tables}/aisle", number)
        finally:
            rows.unpersist()

    return run.start(det, "state_tables", fan_out)


def start_flow(run: StreamRun, det: DataFrame, window_s: int = 60, slide_s: int = 10,
               watermark: str = "1 second") -> StreamingQuery:
    def upsert(batch: DataFrame, number: int) -> None:
        writers.upsert_flow_rate(batch, f"{run.tables}/flow_rate", number)

    return run.start(flow_rate_stream(det, window_s, slide_s, watermark), "flow_rate", upsert)


def _anomalies(run: StreamRun, found: DataFrame, name: str, build: Callable) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        writers.write_anomalies(build(batch), options={"path": f"{run.tables}/{name}"}, batch=number)

    return run.start(found, name, write)


def start_understay(run: StreamRun, det: DataFrame, interval_s: float = 300,
                    watermark: str = "1 minute") -> StreamingQuery:
    found = state.understay_stream(det, interval_s, watermark)
    return _anomalies(run, found, "understay", p.build_understay)


def start_stalled(run: StreamRun, det: DataFrame, **rules) -> StreamingQuery:
    return _anomalies(run, state.stalled_stream(det, **rules), "stalled", p.build_stalled)


def start_lists(run: StreamRun, det: DataFrame, white: DataFrame, black: DataFrame) -> StreamingQuery:
    """Listed plates at the gates: stream joined with the static lists."""
    return _anomalies(run, list_anomaly(det, white, black), "lists", p.build_list_anomaly)


def start_valid_tracks(run: StreamRun, det: DataFrame, **rules) -> StreamingQuery:
    return run.start(state.valid_tracks_stream(det, **rules), "valid_tracks")


def start_scene(run: StreamRun, det: DataFrame, idle_s: float = 5.0) -> StreamingQuery:
    return run.start(state.scene_stream(det, idle_s), "scene")


def start_validation(run: StreamRun, raw: DataFrame) -> StreamingQuery:
    return run.start(invalid_events(raw), "invalid")


def start_pass_through(run: StreamRun, raw: DataFrame, key: str | None = None,
                       iv: str | None = None) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        events = p.parse_events(batch)
        writers.write_pass_through(events, options={"path": f"{run.tables}/events"}, batch=number, key=key, iv=iv)

    return run.start(raw, "pass_through", write)


def await_all(spark: SparkSession, *queries: StreamingQuery) -> None:
    """Wait for drained queries; raises what a query failed with."""
    for q in queries:
        q.awaitTermination()
