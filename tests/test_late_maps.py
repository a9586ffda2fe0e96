import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackdensity.operators import nearest
from trackdensity.plans import registry, stream_queries
from trackdensity.sources import views
from trackdensity.streaming import late_maps

SF = "/root/testdata/sf0.001"
COLUMNS = ["obs_id", "epoch", "dist", "latitude", "longitude", "tec_value"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stream_of_late_maps_equals_the_batch_match(spark):
    points, maps = views.track(spark, SF).select("obs_id", "time", "lat", "lon"), views.map_series(spark, SF)
    want = nearest.best_match(nearest.nearest_on_mesh(points, maps, *registry.MESH, min_points=registry.MIN_POINTS))
    got = stream_queries.stream_late_maps(spark, SF)
    assert rows(got) == rows(want.withColumn("epoch", F.col("epoch").cast("timestamp_ntz"))) and got.count() > 100


@pytest.fixture
def landed(spark, tmp_path):
    """Streams of points and maps over folders to which files are added, and the matches after each run."""
    day = dt.datetime(2024, 1, 1)
    kinds = {"points": "obs_id long, time timestamp, lat double, lon double", "maps": "epoch timestamp, latitude double, longitude double, tec_value double, i int, j int, cells long"}

    def cells(hour, value, n=4):
        return [(day + dt.timedelta(hours=hour), -45.0 + 90 * i, -90.0 + 180 * j, value, i, j, n) for i in (0, 1) for j in (0, 1)]

    def point(obs, hour, lat=-45.0, lon=-90.0):
        return (obs, day + dt.timedelta(hours=hour), lat, lon)

    def add(kind, data):
        spark.createDataFrame(data, kinds[kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))

    def run():
        p, m = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / k)) for k, s in kinds.items())
        found = late_maps.best_match(p, m, (-45.0, 90.0, 2, -90.0, 180.0, 2), "1 hour", "6 hours", 4)
        query = found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        progress = query.lastProgress
        kept = sum(x["numRowsTotal"] for x in progress["stateOperators"]) if progress else None
        return {r["obs_id"]: (r["epoch"].hour, r["tec_value"]) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}, kept

    return add, run, cells, point


def test_a_later_map_wins_until_the_watermark_and_state_is_let_go(landed):
    add, run, cells, point = landed
    add("points", [point(1, 4), point(2, 4, None, None), point(3, 4)])
    add("maps", cells(2, 20.0))
    assert run()[0] == {}  # maps of six hours before may still come
    add("points", [point(3, 4)])  # a repeated row is the same point
    add("maps", cells(5, 50.0))  # nearer in time, after the restart
    add("maps", cells(5, 50.0))  # lands twice
    add("maps", cells(4, 40.0, n=3))  # too small a map, though at the points' own time
    assert run()[0] == {}
    for k in (30, 60):
        add("points", [point(100 + k, k, None, None)])
        add("maps", cells(k, 0.0))
    found, kept = run()
    assert found == {1: (5, 50.0), 3: (5, 50.0)}
    add("points", [point(5, 4)])  # later than allowed: dropped
    add("maps", cells(3, 30.0))
    for k in (90, 120):
        add("points", [point(100 + k, k, None, None)])
        add("maps", cells(k, 0.0))
    again, later = run()
    assert again == found and later <= max(kept, 16)


def test_state_is_packed_by_time_bucket(landed):
    add, run, cells, point = landed
    far = 2**60  # ids that floats don't hold
    add("points", [point(far + k, 4) for k in range(500)] + [(-1, None, -45.0, -90.0), (None, *point(0, 4, 45.0, 90.0)[1:])])  # no time, no id
    add("maps", cells(3, None))
    add("maps", cells(30, float("nan")))
    found, kept = run()
    assert found == {} and kept <= 16  # not a row for each point
    add("points", [point(600, 31)])
    for k in (60, 90):
        add("points", [point(600 + k, k, None, None)])
        add("maps", cells(k, 0.0))
    found, _ = run()
    assert np.isnan(found.pop(600)[1]) and found == dict.fromkeys([None, *range(far, far + 500)], (3, None))


def test_best_of_a_bucket_without_order():
    hour = 3_600_000_000
    points = [(7, 4 * hour, 0.5, 3, True), (7, 4 * hour, 0.5, 0, True), (7, 4 * hour, 0.5, 0, True), (0, 4 * hour, 0.1, 1, False), (8, 9 * hour, 0.1, 1, True), (9, 4 * hour, 0.1, 2, True)]
    cells = [(5 * hour, 50.0, 0, True), (3 * hour, 30.0, 0, True), (3 * hour, 31.0, 3, True), (3 * hour, 30.0, 1, True), (3 * hour, 0.0, 1, False), (8 * hour, 80.0, 2, True)]
    want = [(0, False, 4 * hour, 3 * hour, 0.1, 1, 0.0, False), (7, True, 4 * hour, 3 * hour, 0.5, 0, 30.0, True)]  # equally far: the earlier epoch; twice the same: the least
    rng = np.random.default_rng(1)
    for _ in range(5):
        found = late_maps.best(rng.permutation(np.array(points, late_maps.POINT)), rng.permutation(np.array(cells, late_maps.CELL)), 4, 3 * hour)
        assert list(found.itertuples(index=False, name=None)) == want
