import gzip
import zipfile

from trackdensity.sources import files, landing

from .test_library import MAP

LINE = "2009-01-31 23:50:00.000 GPS 450000.0 190.0 -10.0 3.5 20.0 {} 1e-12 0 0"


def archive(folder, name, lines, broken=False):
    path = folder / f"{name}.zip"
    if broken:
        path.write_bytes(b"not a zip")
        return
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"{name}.txt", "\n".join(lines))


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_archives_in_batches_and_streams(spark, tmp_path):
    land = tmp_path / "in" / "sub"
    land.mkdir(parents=True)
    archive(land, "GA_DNS_ACC_2009_01_v02", [LINE.format(k) for k in range(3)])
    archive(land, "GA_DNS_ACC_2008_12_v02", [], broken=True)  # of another year: never opened, so not even an error
    archive(land, "GA_POS_ACC_2009_01_v02", [], broken=True)
    got = landing.track_lines(spark, str(tmp_path / "in"), (2009, 2010))
    assert got.count() == 3 and got.filter("error is not null").count() == 0

    def run():
        landing.land(landing.track_lines(spark, str(tmp_path / "in"), (2009, 2010), stream=True, per_batch=1), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)

    run()
    archive(land, "GB_DNS_ACC_2010_03_v02", [LINE.format(k) for k in range(5)])
    archive(land, "GB_DNS_ACC_2010_04_v02", [], broken=True)
    run()  # again from the checkpoint: the new files only
    columns = ["value", "mission", "year", "month"]
    every = files.read_track_archives(spark, str(land / "*.zip"), (2009, 2010))
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(every.filter("error is null"), *columns)
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert len(bad) == 1 and bad[0].path.endswith("GB_DNS_ACC_2010_04_v02.zip") and "BadZipFile" in bad[0].error
    assert files.parse_track_lines(spark.read.parquet(str(tmp_path / "out"))).count() == 8


def test_maps_in_batches_and_streams(spark, tmp_path):
    (tmp_path / "codg0010.16i").write_text(MAP)
    (tmp_path / "codg0020.16i.gz").write_bytes(gzip.compress(MAP.encode()))
    (tmp_path / "codg0030.16i.Z").write_bytes(b"\x1f\x9dxx")
    (tmp_path / "codg0040.17i").write_text("of another year, and no map")
    (tmp_path / "codg0050.16i").write_text("no map")
    got = landing.map_cells(spark, str(tmp_path), (2015, 2016))
    assert got.filter("error is null").count() == 2 * len(files.parse_map(MAP))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.filter("error is not null").collect()) == ["codg0030.16i.Z", "codg0050.16i"]
    landing.land(landing.map_cells(spark, str(tmp_path), (2015, 2016), stream=True), str(tmp_path / "o" / "out"), str(tmp_path / "o" / "bad"), str(tmp_path / "o" / "cp")).awaitTermination(120)
    columns = ["epoch", "center", "latitude", "longitude", "tec_value"]
    assert rows(spark.read.parquet(str(tmp_path / "o" / "out")), *columns) == rows(got.filter("error is null"), *columns)
    assert spark.read.parquet(str(tmp_path / "o" / "bad")).count() == 2
