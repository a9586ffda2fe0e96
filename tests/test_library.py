import itertools
import math
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from trackdensity.functions import columns as C
from trackdensity.operators import backtest, boosting, nearest, summaries, timeline
from trackdensity.plans import feature_queries, registry  # noqa: F401
from trackdensity.sources import files, views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The given tables, and a copy whose events hold values of zero, null and below zero."""
    other = tmp_path_factory.mktemp("odd")
    for t in TABLES.split():
        os.symlink(f"{SF}/{t}.parquet", other / f"{t}.parquet")
    (other / "events.parquet").unlink()
    duckdb.sql(f"copy (select * replace (case when event_id % 50 = 0 then 0 when event_id % 50 = 1 then null when event_id % 50 = 2 then -value else value end as value) from '{SF}/events.parquet') to '{other}/events.parquet' (format parquet)")
    return {"given": SF, "odd": str(other)}


@pytest.fixture(scope="module")
def ducks(folders):
    out = {}
    for name, folder in folders.items():
        out[name] = duckdb.connect()
        for t in TABLES.split():
            out[name].execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return out


def norm(v):
    return "None" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v + 0.0) if isinstance(v, float) else str(v)


READS_VALUES = [n for n, q in sorted(registry.SQL.items()) if "rho_obs" in q.split("from events)", 1)[-1] or " obs" in q or "obs" in q.split("density_pairs as", 1)[-1]]


@pytest.mark.parametrize("name, data", [(n, "given") for n in sorted(registry.SQL)] + [(n, "odd") for n in READS_VALUES if n != "payload_kind"])
def test_query_equals_sql(spark, folders, ducks, name, data):
    df = registry.QUERIES[name](spark, folders[data])
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[k]) for k in cols) for r in df.collect())
    q = ducks[data].execute(registry.SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(k)]) for k in cols) for r in q.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_wrap(spark):
    rows = spark.createDataFrame([(x,) for x in (-190.0, 180.0, 360.0, -180.0, 0.0)], "x double").select(C.wrap_lon(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [170.0, -180.0, 0.0, -180.0, 0.0]


def ranges(spark, n, *args):
    """(role, first, end) of the runs of equal roles."""
    roles = [r.role for r in spark.range(n).select(summaries.cyclic_role(F.col("id"), n, *args).alias("role"), "id").orderBy("id").collect()]
    out, at = [], 0
    for role, run in itertools.groupby(roles):
        k = len(list(run))
        if role:
            out.append((role, at, at + k))
        at += k
    return out


def test_cyclic_role(spark):
    shares = (2 / 3, 1 / 6, 1 / 6)
    a = ranges(spark, 60000, 8, shares, (1100, 1100))
    assert len(a) == 18 and a[:3] == [("train", 0, 5000), ("next", 6100, 7350), ("last", 8450, 9700)] and a[-1] == ("last", 56950, 58200)
    b = ranges(spark, 10000, 8, shares, (20, 20))
    assert len(b) == 24 and b[:3] == [("train", 0, 833), ("next", 853, 1061), ("last", 1081, 1289)] and b[-3:] == [("train", 9023, 9654), ("next", 9674, 9831), ("last", 9851, 10000)]
    for n, cycles, gaps in ((30, 10, (0, 0)), (100, 3, (0, 0)), (97, 4, (5, 3)), (50, 2, (40, 40))):
        found = ranges(spark, n, cycles, shares, gaps)
        assert len(found) % 3 == 0 and all(x[2] <= y[1] for x, y in itertools.pairwise(found))
    with pytest.raises(ValueError):
        summaries.cyclic_role(F.col("id"), 5, 2, shares, (0, 0))


def series(n=40):
    """(time or none, id, value or none, lon) in three days, with rows that have no time and repeated times."""
    return [(None if k % 9 == 4 else f"2024-01-0{1 + k * 3 // n} 0{k % 7}:00:00", k, None if k % 4 == 1 or k < 3 else float(k), float(k * 97 % 360 - 180)) for k in range(n)]


def test_timeline_keeps_rows_without_a_bucket(spark):
    given = series()
    d = spark.createDataFrame(given, "t string, id long, v double, lon double").withColumn("t", F.col("t").cast("timestamp")).withColumn("_b", F.lit("x"))
    day, order = F.to_date("t"), ["t", "id"]
    want = sorted(given, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [r.id for r in timeline.row_number(d, day, order).orderBy("rn").collect()] == [r[1] for r in want]
    filled, last = {}, None
    for _, i, v, _ in want:
        last = v if v is not None else last
        filled[i] = last
    first = next(v for _, _, v, _ in want if v is not None)
    assert {r.id: r.v for r in timeline.fill(d, day, order, ["v"]).collect()} == {i: first if v is None else v for i, v in filled.items()}
    seg, k = {}, 0
    for n, r in enumerate(want):
        k += n > 0 and abs(r[3] - want[n - 1][3]) > 180
        seg[r[1]] = k
    out = timeline.segments(d, day, order)
    assert {r.id: r.segment for r in out.collect()} == seg and out.columns == [*d.columns, "segment"]


def test_row_lag_equals_one_window(spark):
    d = spark.range(50).select(F.col("id").alias("rn"), (F.col("id") * 3).alias("v"))
    for k in (1, 7, 60):
        assert {r.rn: r.x for r in timeline.row_lag(d, "v", k, "x").collect()} == {i: (i - k) * 3 if i >= k else None for i in range(50)}


def test_interpolation_of_repeated_points_and_planes(spark):
    maps = spark.createDataFrame([(i, j, 2.0 * i + 5.0 * j if (i, j) != (3, 3) else None) for i in range(4) for j in range(4)], "i int, j int, tec_value double")
    points = [(1.0, 1.0), (1.0, 1.0), (0.25, 2.5), (3.0, 2.0), (2.5, 2.5), (3.0, 2.5), (9.0, 1.0), (None, 1.0)]
    got = nearest.interpolate(spark.createDataFrame(points, "lat double, lon double"), maps, 0.0, 1.0, 0.0, 1.0).collect()
    inside = lambda a, o: a is not None and a <= 3 and not (a > 2 and o > 2)
    assert sorted(str((r.lat, r.lon, r.value)) for r in got) == sorted(str((a, o, 2 * a + 5 * o if inside(a, o) else None)) for a, o in points)


def test_nearest_closed_form_equals_brute(spark):
    t = views.track(spark, SF).limit(150).union(views.track(spark, SF).limit(1).withColumns({"lat": F.lit(90.0), "lon": F.lit(179.9), "obs_id": F.lit(-1).cast("long")}))
    m = views.map_series(spark, SF)
    key = lambda df: sorted((r.obs_id, r.epoch, r.dist) for r in df.collect())
    assert key(nearest.nearest_on_mesh(t, m, *registry.MESH, min_points=64)) == key(nearest.nearest_brute(t, m, 64))


def test_no_nested_loop_join(spark):
    plan = registry._matches(spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_top_share_and_metrics(spark):
    for n, want in ((1, 1.0), (20, 20.0), (21, 20.5)):
        df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("e"))
        assert summaries.top_share(df, F.col("e")).first().top5 == want
    rows = [(1.0, 2.0), (1.0, 3.0), (None, 1.0), (math.inf, 1.0), (1.0, math.nan)]
    m = summaries.metrics(spark.createDataFrame(rows, "y double, p double"), F.col("y"), F.col("p")).first()
    far = summaries.metrics(spark.createDataFrame([(1e9 + k, 1e9 + k + 0.1) for k in range(4)], "y double, p double"), F.col("y"), F.col("p")).first()
    assert abs(far["r2"] - (1 - 0.04 / 5)) < 1e-6
    assert m["count"] == 2 and m["corr"] is None and m["r2"] is None and m["bias"] == 1.5


def test_scale_constant_column(spark):
    d = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.x for r in summaries.scale(d, summaries.scaler_fit(d, ["x"]), ["x"]).collect()] == [-1.0, -1.0]


def test_rolling_equals_one_window(spark):
    d = spark.range(50).select(F.col("id").alias("rn"), (F.col("id") % 7).cast("double").alias("v"))
    got = {r.rn: r.m for r in timeline.rolling_mean(d, F.col("v"), 8, "m").collect()}
    assert all(abs(got[k] - sum(i % 7 for i in range(max(0, k - 7), k + 1)) / min(8, k + 1)) < 1e-9 for k in range(50))


MAP = "\n".join(
    [f"{'   1.0':<60}{'IONEX VERSION / TYPE'}", f"{'  10.0 -10.0 -10.0':<60}LAT1 / LAT2 / DLAT", f"{'-150.0-135.0   5.0'.replace('0-', '0 -'):<60}LON1 / LON2 / DLON", f"{'    -1':<60}EXPONENT"]
    + [f"{'     1':<60}START OF TEC MAP", f"{'  2016     1     1     0     0     0':<60}EPOCH OF CURRENT MAP", f"{'    10.0-150.0-135.0   5.0 450.0':<60}LAT/LON1/LON2/DLON/H", "   10 9999", "   -1   40"]
    + [f"{'     0.0-150.0-135.0   5.0 450.0':<60}LAT/LON1/LON2/DLON/H", "    1    2    3    4", f"{'     1':<60}END OF TEC MAP", f"{'':<60}END OF FILE"]
)


def test_map_text(spark, tmp_path):
    rows = files.parse_map(MAP)
    assert [(r[1], r[2], r[3]) for r in rows[:4]] == [(10.0, -150.0, 1.0), (10.0, -145.0, None), (10.0, -140.0, None), (10.0, -135.0, 4.0)]
    # the mesh is whole, also where a latitude has no row
    assert len(rows) == 12 and [r[3] for r in rows[8:]] == [None] * 4
    part = MAP.replace("     0.0-150.0-135.0   5.0 450.0", "     0.0-145.0-140.0   5.0 450.0").replace("    1    2    3    4", "    1    2").replace(f"{'    -1':<60}EXPONENT\n", "")
    assert [r[3] for r in files.parse_map(part)[:8]] == [10.0, None, None, 40.0, None, 1.0, 2.0, None]
    for bad in (MAP.replace("END OF TEC MAP", ""), MAP.replace("LAT1", "XXXX"), MAP.replace("   -1   40\n", ""), MAP.replace("EPOCH OF", "OTHER OF")):
        with pytest.raises(ValueError):
            files.parse_map(bad)
    (tmp_path / "codg0010.16i").write_text(MAP)
    (tmp_path / "b.txt").write_text("nothing")
    out = files.read_grid_maps(spark, str(tmp_path)).collect()
    assert len(out) == 13 and sum(r.error is not None for r in out) == 1
    named = files.read_grid_maps(spark, str(tmp_path), (2016, 2016), name=files.MAP_NAME)
    assert named.count() == 12 and {r.center for r in named.collect()} == {"codg"}
    assert [(r.year, r.n, r.n_values) for r in files.yearly_counts(named).collect()] == [(2016, 12, 6)]


TRACK = "# head\n2009-01-02 03:04:05.5 GPS 450000.0 190.0 10.0 1.0 2.0 3e-12 {0}\nbad line\n2009-01-02 03:04:15 GPS 450000.0 -10.0 11.0 1.0 2.0 4e-12 {1} # said\n"


def test_track_text_and_archives(spark, tmp_path):
    (tmp_path / "nine.txt").write_text(TRACK.format("", ""))
    nine = files.read_track_text(spark, str(tmp_path / "nine.txt"), files.layout_of("CHAMP")).orderBy("time").collect()
    assert [(r.lon, r.alt_km, r.rho_obs, r.time_sys) for r in nine] == [(-170.0, 450.0, 3e-12, "GPS"), (-10.0, 450.0, 4e-12, "GPS")]
    for name, text in (("GA_DNS_ACC_2009_01_v02", TRACK.format("0 0 0", "0 1 0")), ("GA_DNS_ACC_2012_01_v02", "")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("other.txt", "no")
            z.writestr(f"{name}.txt", text)
    (tmp_path / "GB_DNS_ACC_2009_02_v02.zip").write_bytes(b"not a zip")
    got = files.read_track_archives(spark, str(tmp_path / "*.zip"), (2009, 2010))
    assert {(r.mission, r.year, r.month) for r in got.collect()} == {("GA", 2009, 1), ("GB", 2009, 2)} and got.filter("error is not null").count() == 1
    assert [r.rho_obs for r in files.parse_track_lines(got, files.layout_of(" grace ")).collect()] == [3e-12]
    assert files.parse_track_lines(got, "12col", nominal_only=False).count() == 2


def test_payload_kinds(spark):
    cases = {"html": b" <!doc", "lzw": b"\x1f\x9d" + b"x" * 2000, "gz": b"\x1f\x8b" + b"x" * 2000, "plain": b"     1.0" + b"x" * 2000, "other": b"x" * 2000, "tiny": b"\x1f\x9d"}
    d = spark.createDataFrame(list(cases.items()), "want string, body binary")
    assert all(r.want == r.got for r in d.select("want", files.payload_kind(F.col("body")).alias("got")).collect())
    assert d.filter("want = 'gz'").select(files.payload_kind(F.col("body"), F.lit("Text/HTML; x")).alias("k")).first().k == "html"


def test_sinks_and_index_series(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 05:00:00", 1.0, float("nan")), ("2024-01-03 00:00:00", 2.0, 3.0)], "time string, f107_obs double, Apavg double").withColumn("time", F.col("time").cast("timestamp"))
    got = files.index_daily(d, "2024-01-01 09:00:00", "2024-01-02 09:00:00").collect()
    assert [(str(r.time), r.f107, r.ap_daily) for r in got] == [("2024-01-01 00:00:00", 1.0, None), ("2024-01-03 00:00:00", 2.0, 3.0)]
    with pytest.raises(ValueError):
        files.index_daily(d, "2020-01-01", "2020-01-02")
    for tag in (files.run_tag(True, "pre", 3), files.run_tag(False, "post", 1), files.run_tag(True, "pre", 3)):
        files.write_run(d, str(tmp_path / "runs"), tag)
    assert {(r.tag, r["count"]) for r in spark.read.parquet(str(tmp_path / "runs")).groupBy("tag").count().collect()} == {("dr1_pre_h3", 2), ("dr0_post_h1", 2)}
    files.write_csv(d, str(tmp_path / "c"))
    files.write_table(d, str(tmp_path / "t.parquet"))
    assert files.read_any(spark, str(tmp_path / "c")).count() == files.read_any(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(Exception, match="(?i)path"):
        files.read_any(spark, str(tmp_path / "none.csv"))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="alt_km"):
        files.require(spark.range(1), {"id", "alt_km"})


def test_streaming_hourly_mean_equals_batch(spark, tmp_path):
    from trackdensity.streaming import tracks

    views.track(spark, SF).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = tracks.hourly_mean(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.hour: r.n for r in spark.table("hours").collect()}
    want = {r.hour: r.n for r in batch.groupBy(F.date_trunc("hour", "time").alias("hour")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[h] == n for h, n in got.items())


def test_boosting_keeps_the_best_round(spark, tmp_path):
    assert boosting.stopping_round([5, 4, 4.5, 4.2, 3, 9], 3) == 4 and boosting.stopping_round([5, 4, 4.5, 4.2, 3, 9], 2) == 1
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = spark.range(800).select((F.col("id") * 37 % 101 / 101.0).alias("a"), (F.col("id") * 53 % 97 / 97.0).alias("b"), (F.col("id") % 4 == 0).alias("v"))
    d = boosting.assemble(d.withColumn("y", F.sin(6 * F.col("a")) + F.col("b") + F.pmod(F.xxhash64("a", "b"), F.lit(100)) / 100.0), ["a", "b"]).coalesce(1)
    got = boosting.train_squared(d, "y", rounds=40, depth=2, min_rows=20, validation="v", patience=5)
    errors = boosting.train_squared(d.filter("not v"), "y", rounds=40, depth=2, min_rows=20).evaluateEachIteration(d.filter("v"), "squared")
    assert got.getNumTrees == boosting.stopping_round(errors, 5) + 1 > 12


def test_warm_start_and_saved_stages(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    d = spark.range(600).select((F.col("id") * 37 % 101 / 101.0).alias("a"), (F.col("id") % 4 == 0).alias("v"), F.expr("timestamp '2024-01-01' + make_interval(0,0,0,cast(id % 12 as int))").alias("time"))
    d = boosting.assemble(d.withColumn("y", F.sin(6 * F.col("a"))), ["a"]).coalesce(1)
    fit = lambda rounds, start=None: boosting.newton_boost(d.filter("not v"), d.filter("v"), "y", lambda r: C.pseudo_huber(r, 1.0), lambda k: 0.3, rounds, depth=2, min_rows=5, start=start)
    one, curve = fit(2)
    more, _ = fit(2, one)
    assert len(more.trees) == 4 and curve[1][2] < curve[0][2]
    more.save(spark, str(tmp_path / "model"))
    back = boosting.Stages.load(spark, str(tmp_path / "model"))
    value = lambda m: [r.prediction for r in m.score(d).orderBy("a").limit(20).collect()]
    assert value(back) == value(more)
    out = backtest.rolling_boost(d, "y", 1, lambda r: C.pseudo_huber(r, 1.0), lambda k: 0.3, 1, one, folds=[0, 1], snapshots=str(tmp_path / "snap"), depth=2, min_rows=5)
    assert {(r.fold, r["count"]) for r in out.groupBy("fold").count().collect()} == {(0, 50), (1, 50)}
    assert len(boosting.Stages.load(spark, str(tmp_path / "snap/fold-1")).trees) >= 2
    with pytest.raises(ValueError):
        boosting.assemble(d, ["a"], ["b"])


def test_streamed_matches_equal_batch(spark, tmp_path):
    from trackdensity.streaming import tracks

    views.track(spark, SF).limit(300).repartition(3).write.parquet(str(tmp_path / "in"))
    batch, maps = spark.read.parquet(str(tmp_path / "in")), views.map_series(spark, SF)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracks.match_batches(stream, maps, str(tmp_path / "out"), str(tmp_path / "cp"), registry.MESH).awaitTermination(120)
    key = lambda df: sorted((r.obs_id, r.epoch, r.dist) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(nearest.best_match(nearest.nearest_on_mesh(batch, maps, *registry.MESH, min_points=64)))
