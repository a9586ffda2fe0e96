"""Streaming nearest-cell match with memory: the fallback of the batch operator, kept as state by epoch.

Pairs (a point, an epoch that it is near, the nearest cell) come from points that stream in and maps that
are tables, written once. An epoch's state holds the pairs that may still change, packed by batch of rows,
and the value of the last near match in time order. Event-time timers at every half hour go off once the
watermark has passed them: no earlier point can come any more, so the first of them puts all that is pending
before the watermark's half hour in time order, gives it the value of the last near match where it is far itself,
and emits it. What is emitted leaves the state; an epoch whose window is over drops its last value too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import nearest
from ..operators.tables import saved

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "obs_id long, time timestamp, epoch timestamp, dist double, latitude double, longitude double, tec_value double, fallback_used int"
COLUMNS = ["us", "obs_id", "dist", "latitude", "longitude", "tec_value"]
ROW = np.dtype([(c, "i8" if c in ("us", "obs_id") else "f8") for c in COLUMNS])  # null values are NaN
STEP_US = 30 * 60_000_000  # timers are set at such steps of event time


class Fallback(StatefulProcessor):
    """pending: packed rows that may still change; last: the last near match that was emitted, and the time before which all is."""

    def __init__(self, max_dist: float, hours: int):
        self.max_dist, self.hours = max_dist, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "packed binary")
        self.last = handle.getValueState("last", "known boolean, tec_value double, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps: set[int] = set()
        for batch in rows:
            packed = np.empty(len(batch), ROW)
            for c in COLUMNS:
                packed[c] = batch[c].to_numpy()
            self.pending.appendValue((_ordered(packed).tobytes(),))
            steps.update(np.unique(packed["us"] // STEP_US).tolist())
        for step in steps:
            self.handle.registerTimer((step + 1) * STEP_US // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, value, until = self.last.get() if self.last.exists() else (False, None, 0)
        if expiredTimerInfo.getExpiryTimeInMs() * 1000 <= until or not self.pending.exists():
            return  # an earlier timer of this batch has done it
        end = max(expiredTimerInfo.getExpiryTimeInMs() * 1000, timerValues.getCurrentWatermarkInMs() * 1000 // STEP_US * STEP_US)
        every = _ordered(np.concatenate([np.frombuffer(r[0], ROW) for r in self.pending.get()]))
        n = int(np.searchsorted(every["us"], end))
        out, rest = every[:n], every[n:]
        near = out["dist"] < self.max_dist
        before = np.maximum.accumulate(np.where(near, np.arange(n), -1)) if n else np.zeros(0, int)  # the last near match, itself where it is one
        held = np.nan if value is None else value
        filled = np.where(before >= 0, out["tec_value"][before], held) if n else np.zeros(0)
        if n and before[-1] >= 0:
            last = out["tec_value"][before[-1]]
            known_then, value = True, None if np.isnan(last) else float(last)
        else:
            known_then = known
        if len(rest):
            self.pending.put([(rest.tobytes(),)])
        else:
            self.pending.clear()
        if not len(rest) and pd.Timestamp(end, unit="us") >= pd.Timestamp(key[0]).tz_localize(None) + pd.Timedelta(hours=self.hours):
            self.last.clear()  # no point of this epoch is left
        else:
            self.last.update((bool(known_then), value, end))
        shown = (before >= 0) | bool(known)
        if shown.any():
            gone = lambda x, instead: np.where(near, x, instead)[shown]
            yield pd.DataFrame({
                "obs_id": out["obs_id"][shown], "time": pd.to_datetime(out["us"][shown], unit="us"), "epoch": key[0], "dist": gone(out["dist"], np.inf), "latitude": gone(out["latitude"], np.nan),
                "longitude": gone(out["longitude"], np.nan), "tec_value": filled[shown], "fallback_used": (~near)[shown].astype("int32"),
            })

    def close(self) -> None:
        pass


def _ordered(rows: np.ndarray) -> np.ndarray:
    """By time and point; of a point's pairs the nearest stays, equal distances go by latitude, then longitude."""
    rows = rows[np.lexsort([rows[c] for c in ("longitude", "latitude", "dist", "obs_id", "us")])]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["us"][1:] != rows["us"][:-1]) | (rows["obs_id"][1:] != rows["obs_id"][:-1])
    return rows[fresh]


def with_fallback(stream: DataFrame, maps: DataFrame, mesh: tuple, max_dist: float, late: str = "1 hour", min_points: int = 100, hours: int = 3) -> DataFrame:
    """The rows of nearest.with_fallback as a stream (append mode); points later than `late` are dropped.

    Rows come out when the watermark has passed their half hour. Needs the RocksDB state store.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ready = nearest.mesh_maps(maps, *mesh, min_points=min_points, hours=hours)
    ready.cells = saved(ready.cells, "cells")  # each batch joins this table
    met = nearest.mesh_pairs(stream.select("obs_id", "time", "lat", "lon").withWatermark("time", late), ready)
    met = met.select("obs_id", "time", "epoch", F.unix_micros("time").alias("us"), "dist", "latitude", "longitude", "tec_value")
    return met.groupBy("epoch").transformWithStateInPandas(Fallback(max_dist, hours), OUT, "append", "EventTime")

