"""Registered streaming queries: the track replayed as a stream, held against the batch operators' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from ..streaming import late_maps, matching, replay, tracks
from .registry import MESH, MIN_POINTS, SQL, T, c, query, r6


def _closing(spark: SparkSession, rows: DataFrame, late_days: int, time: str = "time") -> DataFrame:
    """Two rows without a place, later than all others by more than the allowed lateness."""
    end = rows.agg(F.max(time).alias("m")).first()["m"]
    after = spark.range(1, 3).select((-F.col("id")).alias("obs_id"), (F.lit(end) + F.make_interval(days=(F.col("id") * late_days).cast("int"))).alias(time))
    return after.select("*", *[F.lit(None).alias(x) for x in rows.columns if x not in ("obs_id", time)])


@query(T + "select date_trunc('hour', time)::timestamp as hour, round(avg(lat),6) lat, round(avg(alt_km),6) alt_km, round(avg(rho_obs)*1e12,11) rho_e12, count(*) n from track group by 1")
def stream_hourly_mean(spark, sf):
    """Hourly means of the track as a stream of shuffled files."""
    rows = views.track(spark, sf).select("obs_id", "time", "lat", "alt_km", "rho_obs")
    out = replay.replayed(rows, _closing(spark, rows, 61), lambda s: tracks.hourly_mean(s, "60 days")).filter(c("lat").isNotNull())
    return out.select(c("hour").cast("timestamp_ntz").alias("hour"), r6(c("lat")).alias("lat"), r6(c("alt_km")).alias("alt_km"), F.round(c("rho_obs") * 1e12, 11).alias("rho_e12"), "n")  # finer than the data: at 6 places halves would hang on the order of summation


@query(SQL["nearest_cell_fallback"])
def stream_cell_fallback(spark, sf):
    """The fallback match of the track as a stream of shuffled files, with state by epoch."""
    rows, maps = views.track(spark, sf).select("obs_id", "time", "lat", "lon"), views.map_series(spark, sf)
    match = lambda s: matching.with_fallback(s, maps, MESH, 0.2, "60 days", MIN_POINTS)
    out = replay.replayed(rows, _closing(spark, rows, 61), match)
    return out.select("obs_id", c("epoch").cast("timestamp_ntz").alias("epoch"), F.when(c("fallback_used") == 0, c("dist")).alias("dist"), "latitude", "tec_value", "fallback_used")


@query(SQL["nearest_cell_match"])
def stream_late_maps(spark, sf):
    """The best match of each track point where points and maps are streams of shuffled files, so most maps come after their points."""
    points, maps = views.track(spark, sf).select("obs_id", "time", "lat", "lon"), views.map_series(spark, sf)
    maps = maps.join(maps.groupBy("epoch").agg(F.count(F.lit(1)).alias("cells")), "epoch")
    # both streams are closed beyond the end of the longer one
    both = points.select("time").union(maps.select("epoch"))
    ends = [_closing(spark, both.select(*[c("time").alias(t) if x == t else F.lit(None).alias(x) for x in df.columns]), 3660, t) for df, t in ((points, "time"), (maps, "epoch"))]
    ends[1] = ends[1].withColumns({"i": F.lit(-1), "j": F.lit(-1), "cells": F.lit(MIN_POINTS)})  # a map like others, of no place
    match = lambda p, m: late_maps.best_match(p, m, MESH, "3650 days", "3650 days", MIN_POINTS)
    out = replay.replayed_together([points, maps], ends, match)
    return out.select("obs_id", c("epoch").cast("timestamp_ntz").alias("epoch"), "dist", "latitude", "longitude", "tec_value")
