"""Windowed nearest-cell join, collocation and interpolation on integer cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .names import free
from .tables import saved

SIX_HOURS = 21600
NOWHERE = -(2**31)
FOUND = ("dist", "latitude", "longitude", "tec_value")


def epoch_pairs(points: DataFrame, maps: DataFrame, min_points: int = 100, hours: int = 3) -> DataFrame:
    """(point, epoch) with epoch - hours <= time < epoch + hours: an equi-join on time buckets."""
    full = maps.groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points)
    full = full.select("epoch", epoch_bucket(hours).alias("b"))
    return points.withColumn("b", F.explode(time_buckets(hours))).join(full, "b").filter(inside(hours)).drop("b")


def epoch_bucket(hours: int) -> Column:
    """Time bucket of an epoch, as wide as the span of points that it is near."""
    return F.floor(F.unix_timestamp("epoch") / (2 * hours * 3600))


def time_buckets(hours: int) -> Column:
    """Buckets in which the epochs of a point may lie: two at most."""
    t, size = F.unix_timestamp("time"), 2 * hours * 3600
    return F.array_distinct(F.array(F.floor((t - hours * 3600) / size), F.floor((t + hours * 3600) / size)))


def inside(hours: int) -> Column:
    return F.expr(f"time >= epoch - interval {hours} hours and time < epoch + interval {hours} hours")


def nearest_on_mesh(points: DataFrame, maps: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int, min_points: int = 100, hours: int = 3) -> DataFrame:
    """Each point with the nearest cell of each epoch of a full regular mesh.

    One shuffle by epoch, in the order of time, which serves with_fallback too.
    """
    met = mesh_pairs(points.select("obs_id", "time", "lat", "lon"), mesh_maps(maps, lat0, dlat, n_lat, lon0, dlon, n_lon, min_points, hours)).select("obs_id", "time", "epoch", *FOUND)
    first = F.row_number().over(Window.partitionBy("epoch", "time", "obs_id").orderBy(*FOUND))
    return met.repartition("epoch").withColumn("_q", first).filter("_q = 1").drop("_q")


def best_on_mesh(points: DataFrame, maps: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int, min_points: int = 100, hours: int = 3) -> DataFrame:
    """The rows of best_match(nearest_on_mesh(...)): the epochs of a point meet it as one list, so it is shuffled once for the cell and once for its id."""
    ready = mesh_maps(maps, lat0, dlat, n_lat, lon0, dlon, n_lon, min_points, hours)
    us = F.unix_micros("time")
    met = _with_cells(points.select("obs_id", "time", "lat", "lon"), ready)
    least = F.array_min(F.transform("_near", lambda x: F.struct(F.col("dist"), F.abs(us - F.unix_micros(x["epoch"])).alias("away"), x["epoch"].alias("epoch"), F.col("latitude"), F.col("longitude"), x["tec_value"].alias("tec_value"), F.col("time"))))
    one = met.filter(F.size("_near") > 0).select("obs_id", least.alias("c"))
    if ready.odd is not None:
        rest = mesh_candidates(points, ready.odd, *ready.mesh, 0, hours)
        one = one.unionByName(rest.select("obs_id", F.struct("dist", F.abs(us - F.unix_micros("epoch")).alias("away"), "epoch", "latitude", "longitude", "tec_value", "time").alias("c")))
    return one.groupBy("obs_id").agg(F.min("c").alias("c")).select("obs_id", "c.dist", "c.epoch", "c.latitude", "c.longitude", "c.tec_value", "c.time")


@dataclass
class MeshMaps:
    """Maps ready to be met: cells (by time bucket and place, the values of all epochs near that bucket's points), odd (the cells of maps with holes or other places than the mesh's; None without such)."""

    cells: DataFrame
    odd: DataFrame | None
    mesh: tuple
    hours: int


def mesh_maps(maps: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int, min_points: int = 100, hours: int = 3) -> MeshMaps:
    """The maps of min_points cells or more, written once as a table by epoch."""
    inside_mesh = F.filter("cells", lambda x: x["i"].between(0, n_lat - 1) & x["j"].between(0, n_lon - 1))
    places = F.size(F.array_distinct(F.transform(inside_mesh, lambda x: x["i"] * n_lon + x["j"])))
    at_home = F.forall(inside_mesh, lambda x: (x["latitude"] == lat0 + dlat * x["i"]) & (x["longitude"] == lon0 + dlon * x["j"]))
    full = maps.groupBy("epoch").agg(F.collect_list(F.struct("i", "j", "latitude", "longitude", "tec_value")).alias("cells")).filter(F.size("cells") >= min_points)
    full = saved(full.select("epoch", "cells", ((places == n_lat * n_lon) & F.coalesce(at_home, F.lit(False))).alias("regular")), "maps")
    flat = lambda df: df.select("epoch", F.explode("cells").alias("x")).select("epoch", "x.*")
    # the epochs near a point lie in the bucket of the time `hours` before it, or in the next one
    b = epoch_bucket(hours)
    rows = flat(full.filter("regular")).withColumn("b", F.explode(F.array(b - 1, b)))
    cells = rows.groupBy("b", "i", "j").agg(F.collect_list(F.struct("epoch", "tec_value")).alias("epochs"))
    odd = full.filter("not regular")
    return MeshMaps(cells, flat(odd) if odd.limit(1).count() else None, (lat0, dlat, n_lat, lon0, dlon, n_lon), hours)


def mesh_pairs(points: DataFrame, ready: MeshMaps) -> DataFrame:
    """Each point (which may be a stream) with the nearest cell of each epoch near it: dist, epoch, latitude, longitude, tec_value. Maps that are odd give several candidates."""
    met = _with_cells(points, ready).withColumn("_e", F.explode("_near")).select(*points.columns, "_e.epoch", "dist", "latitude", "longitude", F.col("_e.tec_value").cast("double").alias("tec_value"))
    if ready.odd is None:
        return met
    rest = mesh_candidates(points, ready.odd, *ready.mesh, 0, ready.hours)
    return met.unionByName(rest.select(*points.columns, "epoch", "dist", "latitude", "longitude", F.col("tec_value").cast("double").alias("tec_value")))


def _with_cells(points: DataFrame, ready: MeshMaps) -> DataFrame:
    """Each point with its cell and the list _near of the epochs near it: one lookup by time bucket and cell."""
    b = F.floor((F.unix_timestamp("time") - ready.hours * 3600) / (2 * ready.hours * 3600))
    met = mesh_cell(points, *ready.mesh).withColumn("b", b).join(ready.cells, ["b", "i", "j"])
    span, us = ready.hours * 3_600_000_000, F.unix_micros("time")
    near = F.filter("epochs", lambda x: (us >= F.unix_micros(x["epoch"]) - span) & (us < F.unix_micros(x["epoch"]) + span))
    return met.withColumn("_near", near)


def mesh_cell(points: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int) -> DataFrame:
    """Each point with dist, latitude, longitude, i, j of the nearest cell of the mesh (equal distances by latitude, then longitude); i, j are NOWHERE without a place."""
    u = (F.col("lon") - lon0) / dlon
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(n_lat - 1), x)).cast("int")
    found = points.withColumns({"_j0": F.pmod(F.floor(u), F.lit(n_lon)).cast("int"), "_j1": F.pmod(F.ceil(u), F.lit(n_lon)).cast("int")})

    def row(j: str) -> Column:
        dl = F.radians(F.col("lon") - (lon0 + dlon * F.col(j)))
        star = F.degrees(F.atan2(F.sin(F.radians("lat")), F.cos(F.radians("lat")) * F.cos(dl)))
        return (star - lat0) / dlat

    found = found.withColumns({"_v0": row("_j0"), "_v1": row("_j1")})
    four = F.array(*[F.struct(clamp(side(F.col(f"_v{k}"))).alias("i"), F.col(f"_j{k}").alias("j")) for k in (0, 1) for side in (F.floor, F.ceil)])

    def met(x: Column) -> Column:
        lat, lon = lat0 + dlat * x["i"], lon0 + dlon * x["j"]
        return F.struct(C.chord(F.col("lat"), F.col("lon"), lat, lon).alias("dist"), lat.alias("latitude"), lon.alias("longitude"), x["i"].alias("i"), x["j"].alias("j"))

    # a filter on the place would go below a stream's watermark, which such rows move as well
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    cell = [F.coalesce(F.when(placed, F.col(f"_c.{x}")), F.lit(NOWHERE)).alias(x) for x in "ij"]
    return found.withColumn("_c", F.array_min(F.transform(four, met))).select(*points.columns, "_c.dist", "_c.latitude", "_c.longitude", *cell)


def mesh_candidates(points: DataFrame, maps: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int, min_points: int = 100, hours: int = 3) -> DataFrame:
    """Each point with the cells of a full mesh, four at most an epoch, among which is the nearest.

    The nearest column has the least longitude difference; within it the nearest row is the one
    nearest atan2(sin lat, cos lat cos dlon): at most four candidate cells, met by an equi-join.
    Points may be a stream.
    """
    pairs = mesh_cells(epoch_pairs(points, maps, min_points, hours), lat0, dlat, n_lat, lon0, dlon, n_lon)
    met = pairs.join(maps.select("epoch", "i", "j", "latitude", "longitude", "tec_value"), ["epoch", "i", "j"])
    return met.withColumn("dist", C.chord(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")))


def mesh_cells(points: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int) -> DataFrame:
    """Each point with the numbers i, j of its candidate cells; they are the same for every map of the mesh."""
    u = (F.col("lon") - lon0) / dlon
    cols = F.array_distinct(F.array(F.pmod(F.floor(u), F.lit(n_lon)), F.pmod(F.ceil(u), F.lit(n_lon))))
    pairs = points.withColumn("j", F.explode(cols.cast("array<int>")))
    dl = F.radians(F.col("lon") - (lon0 + dlon * F.col("j")))
    star = F.degrees(F.atan2(F.sin(F.radians("lat")), F.cos(F.radians("lat")) * F.cos(dl)))
    v = (star - lat0) / dlat
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(n_lat - 1), x))
    return pairs.withColumn("i", F.explode(F.array_distinct(F.array(clamp(F.floor(v)), clamp(F.ceil(v)))).cast("array<int>")))


def nearest_brute(points: DataFrame, maps: DataFrame, min_points: int = 100, hours: int = 3) -> DataFrame:
    """The same for irregular maps: every cell of each matching epoch is met (an equi-join on epoch)."""
    met = epoch_pairs(points, maps, min_points, hours).join(maps.select("epoch", "latitude", "longitude", "tec_value"), "epoch")
    met = met.withColumn("dist", C.chord(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")))
    return met.groupBy("obs_id", "time", "epoch").agg(F.min(F.struct("dist", "latitude", "longitude", "tec_value")).alias("c")).select("obs_id", "time", "epoch", "c.dist", "c.latitude", "c.longitude", "c.tec_value")


def with_fallback(matches: DataFrame, max_dist: float) -> DataFrame:
    """Beyond max_dist: the value of the previous near match of that epoch, place and distance unset."""
    near = F.col("dist") < max_dist
    w = Window.partitionBy("epoch").orderBy("time", "obs_id").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(near, F.struct("tec_value")), True).over(w)
    out = matches.withColumn("_p", prev).withColumn("fallback_used", (~near).cast("int"))
    out = out.filter(near | F.col("_p").isNotNull())
    gone = lambda c: F.when(near, F.col(c))
    return out.select("obs_id", "time", "epoch", F.when(near, F.col("dist")).otherwise(F.lit(float("inf"))).alias("dist"), gone("latitude").alias("latitude"), gone("longitude").alias("longitude"), F.when(near, F.col("tec_value")).otherwise(F.col("_p.tec_value")).alias("tec_value"), "fallback_used")


def best_match(matches: DataFrame) -> DataFrame:
    """One epoch for each point: least distance, then least time difference, epoch, latitude, longitude."""
    away = F.abs(F.unix_micros("time") - F.unix_micros("epoch"))
    rest = [c for c in matches.columns if c not in ("obs_id", "dist", "epoch", "latitude", "longitude", "tec_value")]
    best = F.min(F.struct("dist", away.alias("away"), "epoch", "latitude", "longitude", "tec_value", *rest)).alias("c")
    return matches.groupBy("obs_id").agg(best).select("obs_id", "c.dist", "c.epoch", "c.latitude", "c.longitude", "c.tec_value", *[f"c.{c}" for c in rest])


def collocate(points: DataFrame, grid: DataFrame, values: list[str], step: float, lat0: float = -90.0, lon0: float = -180.0) -> DataFrame:
    """Left join on integer cells after wrapping; the grid's first cell row (lat, lon order) counts."""
    cell = lambda df: df.withColumn("ci", C.bin_number(F.col("lat"), lat0, step)).withColumn("cj", C.bin_number(C.wrap_lon(F.col("lon")), lon0, step))
    one = cell(grid).groupBy("ci", "cj").agg(F.min(F.struct("lat", "lon", *values)).alias("g")).select("ci", "cj", *[F.col(f"g.{v}").alias(f"{v}_grid") for v in values])
    return cell(points).join(one, ["ci", "cj"], "left")


def interpolate(points: DataFrame, maps: DataFrame, lat0: float, dlat: float, lon0: float, dlon: float) -> DataFrame:
    """Points with the bilinear `value` at (lat, lon); null if a corner of non-zero weight is missing or null.

    maps: i, j, tec_value. Each map cell is known with its three neighbours, so a point needs one lookup.
    """
    i, j, u, v, corner = free(points, "i", "j", "u", "v", "corner")
    y, x = (F.col("lat") - lat0) / dlat, (F.col("lon") - lon0) / dlon
    places = [(a, b) for a in (0, 1) for b in (0, 1)]
    spread = F.explode(F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(2 * a + b).alias("k"), F.col("tec_value").alias("x")) for a, b in places]))
    cells = maps.select(spread.alias("c")).groupBy(F.col("c.i").alias(i), F.col("c.j").alias(j)).agg(F.array(*[F.max(F.when(F.col("c.k") == k, F.col("c.x"))) for k in range(4)]).alias(corner))
    rows = points.withColumns({i: F.floor(y).cast("int"), j: F.floor(x).cast("int"), u: y - F.floor(y), v: x - F.floor(x)})
    weight = lambda a, b: (F.col(u) if a else 1 - F.col(u)) * (F.col(v) if b else 1 - F.col(v))
    parts = [F.when(weight(a, b) == 0, 0.0).otherwise(weight(a, b) * F.col(corner)[2 * a + b]) for a, b in places]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return rows.join(cells, [i, j], "left").select(*points.columns, total.alias("value"))
