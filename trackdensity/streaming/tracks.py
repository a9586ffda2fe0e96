"""Streaming counterparts: hourly means with a watermark, and stream-static cell matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nearest


def hourly_mean(stream: DataFrame, late: str = "3 hours") -> DataFrame:
    """Append mode: an hour comes out once the watermark has passed it; later rows are dropped."""
    return stream.withWatermark("time", late).groupBy(F.window("time", "1 hour").alias("w")).agg(*[F.avg(c).alias(c) for c in ("lat", "alt_km", "rho_obs")], F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "lat", "alt_km", "rho_obs", "n")


def match_batches(stream: DataFrame, maps: DataFrame, sink: str, checkpoint: str, mesh: tuple, min_points: int = 64):
    """Starts a query that writes each micro-batch's best matches to batch=N of a Parquet folder.

    A batch that runs again after a failure replaces its own rows.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        found = nearest.best_match(nearest.nearest_on_mesh(batch, maps, *mesh, min_points=min_points))
        found.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
