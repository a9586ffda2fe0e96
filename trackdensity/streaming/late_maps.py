"""Streaming match of points with maps that arrive late, as a stream of their own.

Points and map cells meet in the state of a time bucket, packed by batch of rows: a point waits
for the maps whose epochs it is near, a map for its points. An event-time timer goes off once the
watermark has passed all epochs near the bucket's points: no map of them can come any more, so
each point gets its best candidate, and the state of the bucket is let go. It holds what lies
between the newest time and the allowed lateness, whatever the streams have carried before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import nearest
from .matching import STORE

OUT = "obs_id long, has_id boolean, us long, epoch_us long, dist double, cell int, tec_value double, has_value boolean"
POINT = np.dtype([("obs_id", "i8"), ("us", "i8"), ("x", "f8"), ("cell", "i4"), ("known", "?")])  # x: dist
CELL = np.dtype([("us", "i8"), ("x", "f8"), ("cell", "i4"), ("known", "?")])  # x: the value, us: of the epoch
SHOWN = 100_000  # rows of a frame that comes out


class Waiting(StatefulProcessor):
    """points, cells: packed rows of a time bucket. A row's x is null where it isn't known (cells), its obs_id where that isn't (points)."""

    def __init__(self, n_cells: int, hours: int):
        self.n_cells, self.hours = n_cells, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "packed binary")
        self.cells = handle.getListState("cells", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = False
        for batch in rows:
            column = {c: batch[c].to_numpy() for c in ("obs_id", "us", "x", "cell", "known", "is_map")}
            for state, kind, which in ((self.points, POINT, ~column["is_map"]), (self.cells, CELL, column["is_map"])):
                which = which & (column["cell"] >= 0)  # others have no place or time
                if which.any():
                    packed = np.empty(int(which.sum()), kind)
                    for c in kind.names:
                        packed[c] = column[c][which]
                    state.appendValue((packed.tobytes(),))
                    stored = True
        if stored:
            self.handle.registerTimer((key[0] + 2) * 2 * self.hours * 3_600_000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = None
        if self.points.exists() and self.cells.exists():
            points, cells = (np.concatenate([np.frombuffer(r[0], kind) for r in state.get()]) for state, kind in ((self.points, POINT), (self.cells, CELL)))
            found = best(points, cells, self.n_cells, self.hours * 3_600_000_000)
        self.points.clear()
        self.cells.clear()
        for k in range(0, 0 if found is None else len(found), SHOWN):
            yield found.iloc[k : k + SHOWN]

    def close(self) -> None:
        pass


def best(points: np.ndarray, cells: np.ndarray, n_cells: int, span: int) -> pd.DataFrame:
    """Of each point (obs_id and time) the least distance, then time difference, epoch, place and value, nulls first; columns as in OUT.

    A point's cell and distance are the same in all maps, so the nearest epoch with that cell wins.
    """
    cells = cells[np.lexsort([cells[c] for c in ("x", "known", "cell", "us")])]
    fresh = np.ones(len(cells), bool)
    fresh[1:] = (cells["us"][1:] != cells["us"][:-1]) | (cells["cell"][1:] != cells["cell"][:-1])
    cells = cells[fresh]  # of a map that landed twice one row a cell
    epochs, of = np.unique(cells["us"], return_inverse=True)
    at = np.full((len(epochs), n_cells), -1)
    at[of, cells["cell"]] = np.arange(len(cells))
    away, chosen = np.full(len(points), np.iinfo("i8").max), np.full(len(points), -1)
    for k, epoch in enumerate(epochs.tolist()):
        row, far = at[k][points["cell"]], np.abs(points["us"] - epoch)
        better = (points["us"] >= epoch - span) & (points["us"] < epoch + span) & (row >= 0) & (far < away)
        away[better], chosen[better] = far[better], row[better]
    met = chosen >= 0
    points, away, cell = points[met], away[met], cells[chosen[met]]
    order = np.lexsort([cell["x"], cell["known"], points["cell"], cell["us"], away, points["x"], points["us"], points["obs_id"], points["known"]])
    points, cell = points[order], cell[order]
    fresh = np.ones(len(points), bool)
    fresh[1:] = (points["us"][1:] != points["us"][:-1]) | (points["obs_id"][1:] != points["obs_id"][:-1]) | (points["known"][1:] != points["known"][:-1])
    points, cell = points[fresh], cell[fresh]
    return pd.DataFrame({"obs_id": points["obs_id"], "has_id": points["known"], "us": points["us"], "epoch_us": cell["us"], "dist": points["x"], "cell": points["cell"], "tec_value": cell["x"], "has_value": cell["known"]})


def best_match(points: DataFrame, maps: DataFrame, mesh: tuple, late: str = "1 hour", map_late: str = "2 days", min_points: int = 100, hours: int = 3) -> DataFrame:
    """The rows of nearest.best_match(nearest.nearest_on_mesh(...)) as a stream (append mode).

    points: obs_id, time, lat, lon. maps: epoch, i, j, latitude, longitude, tec_value of full meshes, and cells (how
    many cells its map has, which the reader of a landed map knows). obs_id, dist, time, epoch, latitude,
    longitude, tec_value come out when the watermark, the older of the two streams', has passed all
    epochs that a point's bucket of 2 * hours is near. Points later than `late` and maps later than `map_late` are
    dropped; a map that lands twice changes nothing; points without a place match nothing; maps of fewer
    than min_points cells match nothing and do not move the watermark. Needs the RocksDB state store.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    lat0, dlat, n_lat, lon0, dlon, n_lon = mesh
    at_home = F.col("i").between(0, n_lat - 1) & F.col("j").between(0, n_lon - 1)
    rows = points.select("obs_id", "time", "lat", "lon").withWatermark("time", late)
    place = nearest.mesh_cell(rows.repartition("obs_id", "time"), *mesh)  # a batch may be one long file
    # a point waits at the bucket `hours` before it; a map cell in its epoch's bucket and the one before

    def packable(b: Column, time: str, obs_id: Column, x: Column, known: Column, is_map: bool) -> list[Column]:
        """No column is null but the event time: pandas would make floats of whole numbers."""
        cell = F.when(at_home & F.col(time).isNotNull(), F.col("i") * n_lon + F.col("j")).otherwise(-1).cast("int")
        return [
            b.alias("b"), F.col(time).alias("t"), F.coalesce(obs_id, F.lit(0)).cast("long").alias("obs_id"), F.coalesce(F.unix_micros(time), F.lit(0)).alias("us"),
            F.coalesce(x.cast("double"), F.lit(0.0)).alias("x"), cell.alias("cell"), known.isNotNull().alias("known"), F.lit(is_map).alias("is_map"),
        ]

    bucket = F.coalesce(F.floor((F.unix_timestamp("time") - hours * 3600) / (2 * hours * 3600)), F.lit(0))
    spread = place.select(packable(bucket, "time", F.col("obs_id"), F.col("dist"), F.col("obs_id"), False))
    near = F.coalesce(nearest.epoch_bucket(hours), F.lit(0))
    cells = maps.filter(F.col("cells") >= min_points).withWatermark("epoch", map_late)
    cells = cells.select(packable(F.explode(F.array(near - 1, near)), "epoch", F.lit(0), F.col("tec_value"), F.col("tec_value"), True))
    found = spread.union(cells).groupBy("b").transformWithStateInPandas(Waiting(n_lat * n_lon, hours), OUT, "append", "EventTime")
    number = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731  (NaN comes out of pandas as null)
    return found.select(
        F.when(F.col("has_id"), F.col("obs_id")).alias("obs_id"), number("dist").alias("dist"), F.timestamp_micros("us").alias("time"), F.timestamp_micros("epoch_us").alias("epoch"),
        (lat0 + dlat * F.floor(F.col("cell") / n_lon)).alias("latitude"), (lon0 + dlon * (F.col("cell") % n_lon)).alias("longitude"), F.when(F.col("has_value"), number("tec_value")).alias("tec_value"),
    )
