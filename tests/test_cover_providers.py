import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from trackdensity.functions import providers
from trackdensity.operators import cover, nearest


def test_cover_equals_brute_force_on_irregular_maps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    epoch = dt.datetime(2024, 1, 1)
    near = [(float(x), float(y)) for x, y in zip(rng.uniform(-88, 88, 150), rng.uniform(-180, 180, 150))]
    odd = [(90.0, 0.0), (-90.0, 33.0), (10.0, 180.0), (10.0, -180.0), (-30.0, 179.99), (89.5, -120.0), (0.0, 0.0)]
    cells = [(epoch, a, b, float(i)) for i, (a, b) in enumerate(near + odd)]
    cells += [(epoch + dt.timedelta(hours=2), float(a), float(b), 1.0) for a, b in zip(rng.uniform(20, 25, 60), rng.uniform(100, 104, 60))]  # all in one corner
    points = [(i, epoch + dt.timedelta(minutes=int(i % 150)), float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-90, 90, 250), rng.uniform(-180, 180, 250)))]
    points += [(1000 + i, epoch, a, b) for i, (a, b) in enumerate([(90.0, 10.0), (-90.0, -10.0), (10.0, 179.999), (10.0, -179.999), (-30.0, -179.99), (89.9, 60.0), (0.0, 0.0), (-89.99, 180.0)])] + [(2000, epoch, None, 1.0)]
    maps = spark.createDataFrame(cells, "epoch timestamp, latitude double, longitude double, tec_value double")
    pts = spark.createDataFrame(points, "obs_id long, time timestamp, lat double, lon double")
    got = cover.nearest_on_cover(pts, maps, size=8.0, min_points=50)
    want = nearest.nearest_brute(pts.filter("lat is not null"), maps, min_points=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 300
    # a cap touches a bounded number of cells, whatever the place and the size
    spread = spark.range(2000).select((F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    for size in (0.5, 5.0, 40.0):
        assert spread.select(F.max(F.size(cover.cap_cells(F.col("lat"), F.col("lon"), size)))).first()[0] <= 40


def test_best_on_cover_keeps_one_row_for_a_point(spark, monkeypatch):
    rng = np.random.default_rng(5)
    epoch = dt.datetime(2024, 1, 1)
    cells = [(epoch + dt.timedelta(hours=2 * e), float(a), float(b), None if i % 7 == e else float(i)) for e in range(5) for i, (a, b) in enumerate(zip(rng.integers(-9, 10, 70) * 10.0, rng.integers(-18, 18, 70) * 10.0))]
    cells += [(epoch + dt.timedelta(hours=30), 1.0, 1.0, 5.0)]  # too few places
    points = [(i, epoch + dt.timedelta(minutes=int(x)), float(a), float(b)) for i, (x, a, b) in enumerate(zip(rng.integers(-400, 1200, 300), rng.integers(-18, 19, 300) * 5.0, rng.integers(-36, 36, 300) * 5.0))]
    points += [(900, epoch, 90.0, 10.0), (901, epoch, None, 1.0), (902, epoch, -90.0, 179.0)]
    maps = spark.createDataFrame(cells, "epoch timestamp, latitude double, longitude double, tec_value double")
    pts = spark.createDataFrame(points, "obs_id long, time timestamp, lat double, lon double")
    rows, save = [], cover.saved
    monkeypatch.setattr(cover, "saved", lambda d, n: rows.append((n, (out := save(d, n)).count())) or out)
    got = cover.best_on_cover(pts, maps, size=8.0, min_points=50)
    want = nearest.best_match(nearest.nearest_brute(pts.filter("lat is not null"), maps, min_points=50))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and want.count() > 150
    assert all(n <= len(points) for name, n in rows if name == "nearest")


PROFILE = providers.Profile((300.0, 400.0, 500.0), (0.0, 6.0, 18.0), ((1e-11, 2e-11, 3e-11), (2e-12, 3e-12, 5e-12), (5e-13, 6e-13, 9e-13)))


def test_provider_forms_agree(spark):
    rng = np.random.default_rng(0)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=int(s), microseconds=500), float(a), float(b), float(h)) for s, a, b, h in zip(rng.integers(0, 10**6, 300), rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), rng.uniform(200, 600, 300))]
    rows += [(None, 0.0, 0.0, 400.0), (t0, 0.0, 0.0, None), (t0, 0.0, 0.0, 400.0), (t0, 0.0, -180.0, 300.0)]
    df = spark.createDataFrame(rows, "time timestamp, lat double, lon double, alt double").repartition(3)
    place = [F.col(c) for c in ("time", "lat", "lon", "alt")]

    def build():
        model = PROFILE.model()

        def small(us, *rest):
            assert len(us) <= 7  # the batch size is kept
            return model(us, *rest)

        return small

    out = df.select(PROFILE(*place).alias("a"), providers.batched(build, 7)(*place).alias("b"), providers.batched(PROFILE.model)(*place).alias("c"), "alt", "time").collect()
    assert len(out) == 304
    for r in out:
        assert (r.a is None) == (r.b is None) == (r.time is None or r.alt is None)
        assert r.a is None or (np.isclose(r.a, r.b, rtol=1e-9) and r.b == r.c)
    node = spark.range(1).select(*[PROFILE.at(F.lit(h), F.lit(a)).alias(f"x{k}") for k, (h, a) in enumerate(((0.0, 400.0), (6.0, 500.0), (21.0, 300.0), (3.0, 450.0)))]).first()
    assert np.allclose(tuple(node), (2e-12, 6e-13, (3e-11 * 1e-11) ** 0.5, (2e-12 * 3e-12 * 5e-13 * 6e-13) ** 0.25))
    moved = df.select(providers.transferred(providers.exponential, F.lit(2.0), *place[:3], F.lit(400.0), F.lit(460.0)).alias("x")).first().x
    assert np.isclose(moved, 2 * np.exp(-1))


def test_small_column_functions(spark):
    from trackdensity.functions import columns as C
    from trackdensity.operators import summaries

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10), 170.0, 1.0), (dt.datetime(2024, 1, 1, 0, 20), -170.0, 3.0), (dt.datetime(2024, 1, 1, 1, 0), None, 5.0)], "time timestamp, lon double, rho_ref double")
    means = {r.hour.hour: r for r in summaries.hourly_means(df, circular=("lon",)).collect()}
    assert abs(abs(means[0].lon) - 180) < 1e-9 and means[0].rho_ref == 2.0 and means[1].lon is None
    both = df.withColumn("Rho_Obs", F.lit(9.0))
    assert df.select(C.observed_or_reference(df, "rho_obs", "rho_ref").alias("x")).first().x == 1.0
    assert both.select(C.observed_or_reference(both, "rho_obs", "rho_ref").alias("x")).first().x == 9.0
    try:
        C.observed_or_reference(df, "a", "b")
        raise AssertionError
    except ValueError:
        pass
    at = lambda *a: df.limit(1).select(F.unix_micros(C.threshold(*a)).alias("t")).first().t
    assert at("2024-01-15 12:00:00") == at("2024-01-15T12:00:00Z", "Asia/Tokyo") == at("2024-01-15 21:00:00", "Asia/Tokyo")
    assert at("2024-07-01 02:30:15.25", "Europe/Berlin") == at("2024-07-01 00:30:15.25")
