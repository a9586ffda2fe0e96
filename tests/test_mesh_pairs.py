import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackdensity.operators import nearest
from trackdensity.plans import registry
from trackdensity.sources import views
from trackdensity.streaming import matching

SF = "/root/testdata/sf0.001"


def test_a_point_meets_one_cell_an_epoch_and_odd_maps_all_candidates(spark):
    t, m = views.track(spark, SF).select("obs_id", "time", "lat", "lon").limit(200), views.map_series(spark, SF)
    ready = nearest.mesh_maps(m, *registry.MESH, min_points=64)
    pairs = nearest.epoch_pairs(t, m, 64).count()
    assert ready.odd is None and nearest.mesh_pairs(t, ready).count() == pairs  # before: up to four rows a pair were shuffled
    # maps with a hole, and with a cell beside its place: candidates are met one by one, as before
    odd = m.filter(~((F.hour("epoch") == 4) & (F.col("i") == 3))).withColumn("latitude", F.col("latitude") + F.when(F.hour("epoch") == 8, 0.25).otherwise(0.0))
    key = lambda df: sorted(map(tuple, df.select("obs_id", "epoch", *nearest.FOUND).collect()), key=str)
    met = nearest.mesh_candidates(t, odd, *registry.MESH, min_points=50)
    want = met.groupBy("obs_id", "time", "epoch").agg(F.min(F.struct(*nearest.FOUND)).alias("c")).select("obs_id", "time", "epoch", "c.*")
    assert nearest.mesh_maps(odd, *registry.MESH, min_points=50).odd is not None
    assert key(nearest.nearest_on_mesh(t, odd, *registry.MESH, min_points=50)) == key(want) and want.count() > 300
    assert key(nearest.best_on_mesh(t, odd, *registry.MESH, min_points=50)) == key(nearest.best_match(want))


class Kept:
    """A handle whose states are lists in memory; it counts the rows that are read."""

    def __init__(self):
        self.rows, self.value, self.timers, self.reads = [], None, set(), 0

    getListState = getValueState = lambda self, name, schema: self.List(self) if name == "pending" else self.Value(self)
    registerTimer = lambda self, at: self.timers.add(at)

    class List:
        def __init__(self, h):
            self.h = h

        exists = lambda self: bool(self.h.rows)
        appendValue = lambda self, v: self.h.rows.append(v)
        put = lambda self, v: setattr(self.h, "rows", list(v))
        clear = lambda self: setattr(self.h, "rows", [])

        def get(self):
            self.h.reads += len(self.h.rows)
            return iter(self.h.rows)

    class Value:
        def __init__(self, h):
            self.h = h

        exists = lambda self: self.h.value is not None
        get = lambda self: self.h.value
        update = lambda self, v: setattr(self.h, "value", v)
        clear = lambda self: setattr(self.h, "value", None)


class At:
    def __init__(self, ms):
        self.ms = ms

    getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: self.ms


def test_state_is_packed_and_read_once_for_all_timers_of_a_batch():
    start = pd.Timestamp("2024-01-01")
    us, n = start.value // 1000, 5000
    at = us + np.arange(n) * 3_600_000_000 // 1000
    rows = pd.DataFrame({"us": at, "obs_id": np.arange(n), "dist": np.where(np.arange(n) % 7 == 3, 0.1, 0.5), "latitude": 1.0, "longitude": 2.0, "tec_value": np.where(np.arange(n) % 2, np.nan, np.arange(n))})
    h, f = Kept(), matching.Fallback(0.2, 3)
    f.init(h)
    list(f.handleInputRows((start,), iter([rows.sample(frac=1, random_state=1)]), None))
    assert len(h.rows) == 1 and len(h.timers) > 5
    made = [x for end in sorted(h.timers) for x in f.handleExpiredTimer((start,), At(max(h.timers)), At(end))]
    assert h.reads == 1 and not h.rows
    out, value = pd.concat(made), None
    want = []
    for r in rows.itertuples():
        if r.dist < 0.2:
            value = (r.tec_value,)
            want.append((r.obs_id, r.tec_value, 0))
        elif value:
            want.append((r.obs_id, value[0], 1))
    assert str([tuple(map(float, x)) for x in out[["obs_id", "tec_value", "fallback_used"]].to_numpy()]) == str([tuple(map(float, x)) for x in want])
