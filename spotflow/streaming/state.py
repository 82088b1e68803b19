"""Keyed state on streams: short stays, stops, track filter, live scene.

Rules run on event time. Rows of a key that arrive together are put in order
first; timers are event-time timers, so a restart or a slow trigger does not
change what is found.

State lives in the RocksDB store: one value per key and, for rows held back, a list
that is appended to without being read. A key has one timer at most, named in its value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spotflow.operators import anomaly
from spotflow.operators.projections import with_vehicle_key
from spotflow.operators.quality import identified_only
from spotflow.operators.scene import vehicle_view

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep keyed state in RocksDB, and write only its changes at each batch."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class KeyState:
    """The value of one key during one call, and the time at which it wants to be woken."""

    def __init__(self, value, handle: StatefulProcessorHandle, watermark_ms: int, timed_out: bool):
        self._value, self._handle, self.watermark_ms, self.timed_out = value, handle, watermark_ms, timed_out
        held = value.get() if value.exists() else None
        self.get = None if held is None else tuple(held)[:-1]
        self._due = None if held is None else tuple(held)[-1]

    @property
    def exists(self) -> bool:
        return self.get is not None

    def _timer(self, due: int | None, fired: bool) -> None:
        if self._due is not None and self._due != due and not fired:
            self._handle.deleteTimer(self._due)
        if due is not None and (due != self._due or fired):
            self._handle.registerTimer(due)
        self._due = due

    def update(self, values: tuple, wake_us: int | None = None) -> None:
        """Keep these values; wake the key once the watermark is past a time, and never before it is."""
        due = None if wake_us is None else max(int(wake_us) // 1000 + 1, self.watermark_ms + 1)
        self._timer(due, self.timed_out)
        plain = (v.item() if hasattr(v, "item") else v for v in values)
        self._value.update((*plain, due))
        self.get = values

    def remove(self) -> None:
        if self.exists:
            self._timer(None, self.timed_out)
            self._value.clear()
            self.get = None


class Follower(StatefulProcessor):
    """Calls ``follow(key, batches, state)`` for the rows of a key, and without rows when its timer fires."""

    def __init__(self, follow, schema: str):
        self.follow, self.schema = follow, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.schema}, due long")

    def _call(self, key, batches, timers, timed_out) -> Iterator[pd.DataFrame]:
        state = KeyState(self.value, self.handle, timers.getCurrentWatermarkInMs(), timed_out)
        yield from self.follow(key, batches, state)

    def handleInputRows(self, key, rows, timerValues):
        yield from self._call(key, rows, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._call(key, iter(()), timerValues, True)

    def close(self) -> None:
        pass


def followed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "append", "EventTime")


def _ordered(batches: Iterable[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def _text_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("string"))


# -- short stays ---------------------------------------------------------------------

_STAY = ("site", "level", "spot", "object_id", "license")
_STAY_OUT = (
    "plate string, entry_id string, " + "".join(f"{c} string, " for c in _STAY)
    + "start_us long, entry_video string, exit_id string, end_us long, exit_video string"
)
_STAY_STATE = (
    "entry_id string, " + "".join(f"{c} string, " for c in _STAY) + "us long, video string, open boolean"
)


def understay_stream(df: DataFrame, interval_s: float = 300, watermark: str = "1 minute") -> DataFrame:
    """Entries followed by an exit within ``interval_s``, once per entry."""
    limit = int(interval_s * 1_000_000)
    rows = with_vehicle_key(identified_only(_text_id(df))).where(F.col("type").isin("entry", "exit"))
    keyed = rows.withWatermark("ts", watermark).select(
        "plate", "ts", "id", "type", *_STAY, F.coalesce("video", F.lit("")).alias("video"),
        F.unix_micros("ts").alias("us"),
    )

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: KeyState) -> Iterator[pd.DataFrame]:
        if state.timed_out:
            state.remove()
            return
        entry = state.get if state.exists else None
        out = []
        for r in _ordered(batches, ["us", "id"]).itertuples(index=False):
            if r.type == "entry":
                entry = (r.id, *[getattr(r, c) for c in _STAY], r.us, r.video, True)
            elif entry is not None and entry[-1] and entry[-3] < r.us < entry[-3] + limit:
                out.append((key[0], *entry[:-1], r.id, r.us, r.video))
                entry = (*entry[:-1], False)
        if entry is not None:
            state.update(entry, entry[-3] + limit)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STAY_OUT.split(", ")])

    found = followed(keyed, ["plate"], Follower(follow, _STAY_STATE), _STAY_OUT)
    return found.select(
        "plate", "entry_id", *_STAY, F.timestamp_micros("start_us").alias("start_ts"), "entry_video",
        "exit_id", F.timestamp_micros("end_us").alias("end_ts"), "exit_video",
    )


# -- stops -----------------------------------------------------------------------------------

_WHO_COLS = "".join(f"{c} string, " for c in anomaly.WHO)
_STOP_STATE = (
    f"ms long, x double, y double, {_WHO_COLS}last_ms long, video string, armed boolean, stopped boolean, "
    f"w long, w_ms long, w_x double, w_y double, {_WHO_COLS.replace(' string', '_w string')}"
    "w_last long, w_video string, w_entry boolean, x_min double, x_max double, y_min double, y_max double"
)
_STOP_NAMES = [f.split()[0] for f in _STOP_STATE.split(", ")]
_STOP_EMPTY = {
    n: ("" if k == "string" else False if k == "boolean" else 0.0 if k == "double" else 0)
    for n, k in (f.split() for f in _STOP_STATE.split(", "))
}


def _open_window(r, w: int) -> dict:
    return {"w": w, "first": {c: getattr(r, c) for c in ("ms", "x", "y", *anomaly.WHO)}, "first_ms": r.ms,
            "last_ms": r.ms, "video": r.video, "has_entry": r.type == "entry",
            "x_min": r.x, "x_max": r.x, "y_min": r.y, "y_max": r.y}


def _widen(win: dict, r) -> None:
    win.update(
        last_ms=r.ms, video=r.video, has_entry=win["has_entry"] or r.type == "entry",
        x_min=min(win["x_min"], r.x), x_max=max(win["x_max"], r.x),
        y_min=min(win["y_min"], r.y), y_max=max(win["y_max"], r.y),
    )


def _pack_stop(stop: dict | None, win: dict | None) -> tuple:
    s = {**_STOP_EMPTY, "w": -1}
    if stop is not None:
        s.update(stop["anchor"], last_ms=stop["last_ms"], video=stop["video"], armed=stop["armed"], stopped=True)
    if win is not None:
        f = win["first"]
        s.update({f"{c}_w": f[c] for c in anomaly.WHO}, w=win["w"], w_ms=f["ms"], w_x=f["x"], w_y=f["y"],
                 w_last=win["last_ms"], w_video=win["video"], w_entry=win["has_entry"],
                 **{b: win[b] for b in anomaly.BOUNDS})
    kinds = {int: int, float: float, bool: bool, str: str}
    return tuple(kinds[type(_STOP_EMPTY[n])](s[n]) if s[n] is not None else None for n in _STOP_NAMES)


def _unpack_stop(values: tuple) -> tuple[dict | None, dict | None]:
    s = dict(zip(_STOP_NAMES, values))
    stop = win = None
    if s["stopped"]:
        stop = {"anchor": {k: s[k] for k in ("ms", "x", "y", *anomaly.WHO)},
                **{k: s[k] for k in ("last_ms", "video", "armed")}}
    if s["w"] >= 0:
        first = {"ms": s["w_ms"], "x": s["w_x"], "y": s["w_y"], **{c: s[f"{c}_w"] for c in anomaly.WHO}}
        win = {"w": s["w"], "first": first, "first_ms": s["w_ms"], "last_ms": s["w_last"], "video": s["w_video"],
               "has_entry": s["w_entry"], **{b: s[b] for b in anomaly.BOUNDS}}
    return stop, win


def stalled_stream(df: DataFrame, window_s: int = 30, extent: float = 4.0, min_s: float = 20.0,
                   stale_s: float = 300.0, watermark: str = "10 seconds") -> DataFrame:
    """Stops as in :func:`~spotflow.operators.anomaly.stalled_episodes`.

    The state is the stop followed so far and the summary of the open window,
    never rows. A window closes with the plate's first row of a later one, or
    when the watermark passes its end.
    """
    length = window_s * 1000
    rows = anomaly.on_the_way(_text_id(df)).withWatermark("ts", watermark).select(
        "plate", "ts", "id", "type", "x", "y", *anomaly.WHO, F.unix_millis("ts").alias("ms"),
        F.unix_micros("ts").alias("us"), F.coalesce("video", F.lit("")).alias("video"),
    )
    schema = anomaly.EPISODE.replace("window_start timestamp", "window_no long")
    names = [c.split()[0] for c in schema.split(", ")]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: KeyState) -> Iterator[pd.DataFrame]:
        stop, win = _unpack_stop(state.get) if state.exists else (None, None)
        out = []

        def close():
            nonlocal stop, win
            stop, hit = anomaly.advance_stop(stop, win, extent, min_s, stale_s)
            if hit:
                out.append((key[0], win["w"], *[hit[c] for c in anomaly.WHO], hit["ms"], hit["end_ms"], hit["video"]))
            win = None

        if state.timed_out:
            if win is not None:
                close()
            else:
                stop = None
        else:
            for r in _ordered(batches, ["us", "id"]).itertuples(index=False):
                w = r.ms // length
                if win is not None and w > win["w"]:
                    close()
                if win is None:
                    win = _open_window(r, w)
                elif w == win["w"]:
                    _widen(win, r)
        if stop is None and win is None:
            if state.exists:
                state.remove()
        else:
            # An armed stop ends when it is stale; a moved one ends with the next row after that.
            due = (win["w"] + 1) * length if win else stop["last_ms"] + int(stale_s * 1000)
            state.update(_pack_stop(stop, win), due * 1000 if win is not None or stop["armed"] else None)
        if out:
            yield pd.DataFrame(out, columns=names)

    found = followed(rows, ["plate"], Follower(follow, _STOP_STATE), schema)
    return found.select(
        "plate", F.timestamp_millis(F.col("window_no") * length).alias("window_start"), *anomaly.WHO,
        F.timestamp_millis("start_ms").alias("start_ts"), F.timestamp_millis("end_ms").alias("end_ts"), "video",
    )


# -- track filter ------------------------------------------------------------------------------


class TrackFilter(StatefulProcessor):
    """Rows of a key are cut into tracks at gaps; a track's rows are held until it is long enough.

    The value has the track's start, its last time, whether it is released, and the timer;
    rows held back are a list, read once when they are released.
    """

    def __init__(self, keys: list[str], gap: int, least: int):
        self.keys, self.gap, self.least = keys, gap, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", "start long, last long, free boolean, due long")
        self.held = handle.getListState("held", "id string, us long")

    def handleInputRows(self, key, rows, timerValues):
        state = KeyState(self.track, self.handle, timerValues.getCurrentWatermarkInMs(), False)
        new = _ordered(rows, ["us", "id"])[["id", "us"]]
        start, last, free = state.get or (None, None, False)
        us = new["us"].to_numpy("int64")
        before = us.copy()
        before[1:] = us[:-1]
        cut = us - before >= self.gap
        cut[0] = last is None or us[0] - last >= self.gap
        track = cut.cumsum()  # 0: the track that is in the state
        if cut[0]:
            self.held.clear()
        begun = pd.Series(us).groupby(track).transform("min").to_numpy()
        if not cut[0]:
            begun[track == 0] = start
        ended = pd.Series(us).groupby(track).transform("max").to_numpy()
        released = ended - begun > self.least
        if not cut[0] and free:
            released[track == 0] = True
        parts = []
        if released[0] and not cut[0]:  # what was held of this track goes first
            old = list(self.held.get())
            if old:
                parts.append(pd.DataFrame(old, columns=["id", "us"]).assign(start_us=start))
            self.held.clear()
        if released.any():
            parts.append(new[released].assign(start_us=begun[released]))
        waiting = (track == track[-1]) & ~released
        if track[-1] != track[0]:
            self.held.clear()
        if waiting.any():
            self.held.appendList([(i, int(u)) for i, u in new[waiting].itertuples(index=False, name=None)])
        state.update((int(begun[-1]), int(us[-1]), bool(released[-1])), int(us[-1]) + self.gap)
        if parts:
            out = pd.concat(parts, ignore_index=True)
            for name, value in zip(self.keys, key):
                out[name] = value
            yield out[[*self.keys, "id", "us", "start_us"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.track.clear()
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def valid_tracks_stream(df: DataFrame, keys: list[str] = ["sensor", "object_id"], gap_s: float = 6.0,
                        min_s: float = 3.0, watermark: str = "1 second") -> DataFrame:
    """Rows of tracks longer than ``min_s``; held back until the track is that long.

    Output: keys, id, ts, track_start. The state holds at most ``min_s`` of rows per track.
    """
    gap, least = int(gap_s * 1_000_000), int(min_s * 1_000_000)
    rows = _text_id(df).withWatermark("ts", watermark).select(
        *keys, "ts", "id", F.unix_micros("ts").alias("us")
    )
    key_cols = ", ".join(f"{k} string" for k in keys)
    schema = f"{key_cols}, id string, us long, start_us long"

    found = followed(rows, keys, TrackFilter(keys, gap, least), schema)
    return found.select(
        *keys, "id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("start_us").alias("track_start")
    )


# -- live scene ---------------------------------------------------------------------------------

_VIEW = (
    "id string, us long, site string, level string, object_id string, license string, spot string, "
    "state string, type string, removed int, x double, y double, lat double, lon double"
)
_VIEW_NAMES = [c.split()[0] for c in _VIEW.split(", ")]


def scene_stream(df: DataFrame, idle_s: float = 5.0, watermark: str = "1 second") -> DataFrame:
    """Every change of the scene as a row; vehicles that fall idle come once more, removed.

    Keyed by site, level and object. Moving and entry rows restart the idle timer and an
    exit stops it. Spot events, and all others, pass beside the state.
    """
    idle = int(idle_s * 1_000_000)
    view = vehicle_view(_text_id(df).where("type <> 'reset'")).withWatermark("ts", watermark)
    rows = view.select("ts", *[F.unix_micros("ts").alias("us") if c == "us" else F.col(c) for c in _VIEW_NAMES])
    on_the_move = F.coalesce(F.col("type").isin("moving", "entry", "exit"), F.lit(False))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: KeyState) -> Iterator[pd.DataFrame]:
        if state.timed_out:
            gone = dict(zip(_VIEW_NAMES, state.get))
            state.remove()
            yield pd.DataFrame([{**gone, "removed": 1}], columns=_VIEW_NAMES)
            return
        last = dict(zip(_VIEW_NAMES, state.get)) if state.exists else None
        out = []
        for r in _ordered(batches, ["us", "id"]).itertuples(index=False):
            row = {c: getattr(r, c) for c in _VIEW_NAMES}
            if last is not None and row["us"] - last["us"] >= idle:
                out.append({**last, "removed": 1})
                last = None
            out.append(row)
            if r.type in ("moving", "entry"):
                last = row
            elif r.type == "exit":
                last = None
        if last is not None:
            state.update(tuple(last[c] for c in _VIEW_NAMES), last["us"] + idle)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_VIEW_NAMES)

    moved = followed(rows.where(on_the_move), ["site", "level", "object_id"], Follower(follow, _VIEW), _VIEW)
    found = moved.select(*_VIEW_NAMES).unionByName(rows.where(~on_the_move).select(*_VIEW_NAMES))
    return found.select(
        *[F.timestamp_micros("us").alias("ts") if c == "us" else F.col(c) for c in _VIEW_NAMES]
    )
