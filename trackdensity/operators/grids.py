"""Latitude-longitude grids on integer cells, merged with maps and with one instant's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def axis(start: float, stop: float, step: float) -> int:
    """Number of steps from start that stay below stop."""
    n = (stop - start) / step
    return max(0, int(n) + (1 if n - int(n) > 1e-9 else 0))


def lat_lon(spark: SparkSession, lat: tuple[float, float, float] = (-87.5, 90.0, 0.2), lon: tuple[float, float, float] = (-180.0, 185.0, 0.09)) -> DataFrame:
    """i, j, lat, lon of half-open ranges (start, stop, step); rows of latitudes are dealt over tasks.

    Longitudes beyond 180 repeat those from -180 on.
    """
    n_lat, n_lon = axis(*lat), axis(*lon)
    rows = spark.range(n_lat).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_lon - 1))).alias("j"))
    return rows.select("i", "j", (lat[0] + F.col("i") * lat[2]).alias("lat"), (lon[0] + F.col("j") * lon[2]).alias("lon"))


def at_instant(grid: DataFrame, instant: DataFrame, doy_period: float = 365) -> DataFrame:
    """Grid cells with the columns of one instant (one row: time, alt_km, ...) and the features of its whole hour."""
    both = grid.crossJoin(F.broadcast(instant))
    return both.withColumns(C.instant_features(F.col("time"), F.col("lon"), F.col("lat"), doy_period))


def with_map(grid: DataFrame, maps: DataFrame, epoch) -> DataFrame:
    """Grid cells (i, j) with tec_value of the map at `epoch`; lags, unknown for a map that stands alone, repeat it."""
    one = maps.filter(F.col("epoch") == F.lit(epoch).cast("timestamp")).select("i", "j", "tec_value")
    return grid.join(one, ["i", "j"], "left").withColumns({"vtec_lag": F.col("tec_value"), "vtec_lag2": F.col("tec_value")})


def with_indices(df: DataFrame, instant: DataFrame, vector: str = "aps") -> DataFrame:
    """Every row with one instant's index values (one row); a vector of other than seven values is an error."""
    found = instant.select(F.size(vector)).take(2)
    if len(found) != 1 or found[0][0] != 7:
        raise ValueError(f"one row with seven values in {vector} is needed")
    return df.crossJoin(F.broadcast(instant))
