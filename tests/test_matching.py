import datetime as dt

from pyspark.sql import functions as F

from trackdensity.operators import nearest
from trackdensity.plans import registry
from trackdensity.sources import views
from trackdensity.streaming import matching

SF = "/root/testdata/sf0.001"


def test_shuffled_restarted_stream_equals_the_batch_fallback(spark, tmp_path):
    points, maps = views.track(spark, SF).select("obs_id", "time", "lat", "lon"), views.map_series(spark, SF)
    want = nearest.with_fallback(nearest.nearest_on_mesh(points, maps, *registry.MESH, min_points=64), 0.2)
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    points.repartition(3, F.hash("obs_id")).write.parquet(landing)  # each file holds points of all days

    def run():
        stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        found = matching.with_fallback(stream, maps, registry.MESH, 0.2, late="60 days", min_points=64)
        found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)

    run()
    early = spark.read.schema(matching.OUT).parquet(out).count()
    # the stream starts again from its state: points of a far later day move the watermark past all others
    spark.createDataFrame([(-k, dt.datetime(2025, 1, 1) + dt.timedelta(days=90 * k), 0.0, 0.0) for k in (1, 2)], points.schema).coalesce(1).write.mode("append").parquet(landing)
    run()
    rows = lambda df: sorted(tuple(r) for r in df.select("obs_id", "time", "epoch", "dist", "latitude", "longitude", "tec_value", "fallback_used").collect())
    got = rows(spark.read.schema(matching.OUT).parquet(out))
    assert early == 0 and sum(r[-1] for r in got) > 5 and got == rows(want)
