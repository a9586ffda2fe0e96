"""Tables of the library's shapes, derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FROM_EVENTS = """event_id obs_id, cast(ts as timestamp) time,
  cast((event_id*37)%1750 as double)/10.0D - 87.5D lat, cast((event_id*91)%3600 as double)/10.0D lon_deg,
  cast((event_id*91+1800)%3600 as double)/10.0D - 180.0D lon, 450.0D + cast(user_id%100 as double)*0.5D alt_km,
  value*1e-14D rho_obs, case when event_type='error' then 1 else 0 end flag_dens, cast(get_json_object(props,'$.k') as int) ap"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*[x.strip() for x in _columns(FROM_EVENTS)])


def _columns(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def map_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return cells.selectExpr(
        "timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(vec_id*2 as int),0,0) epoch", "-87.5D + 25.0D*(p div 8) latitude", "-180.0D + 45.0D*(p%8) longitude",
        "case when (vec_id*64+p)%97=0 then null else round(20.0D + 40.0D*cast(x as double), 6) end tec_value", "cast(p div 8 as int) i", "cast(p%8 as int) j",
    )


def index_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of cents in whole numbers, so that it does not depend on the order of summation."""
    tenths = F.expr("sum(cast(round(o_totalprice * 100) as bigint)) * 10 div count(1)")
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((tenths.cast("double") / F.lit(1e6)).alias("f107"))


def index_3h(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("time") / 10800) * 10800)
    return track(spark, sf_dir).groupBy(slot.alias("time")).agg(F.avg("ap").alias("ap"))


def index_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).filter("flag_dens = 1").groupBy(F.date_trunc("hour", "time").alias("time")).agg(F.avg("ap").alias("ap"))


SERIES_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(*SERIES_ORDER, F.col("l_quantity").cast("double").alias("value"))


def density_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).withColumn("obs", F.col("rho_obs")).withColumn("ref", F.expr("1e-12D*exp(-(alt_km-450D)/60D)")).withColumn("pred", F.expr("ref*(1+0.001D*(obs_id%200-100))"))


def grid(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """35 x 72 cells of 5 degrees with integer cell numbers."""
    return spark.range(35).selectExpr("cast(id as int) gi", "-85.0D + 5*id lat").crossJoin(spark.range(72).selectExpr("cast(id as int) gj", "-180.0D + 5*id lon"))


# the same tables in DuckDB's SQL, for the oracles
TRACK_SQL = """track as (select event_id obs_id, cast(ts as timestamp) as time, cast((event_id*37)%1750 as double)/10.0 - 87.5 lat,
  cast((event_id*91)%3600 as double)/10.0 lon_deg, cast((event_id*91+1800)%3600 as double)/10.0 - 180.0 lon, 450.0::double + cast(user_id%100 as double)*0.5 alt_km,
  value*1e-14::double rho_obs, case when event_type='error' then 1 else 0 end flag_dens, cast(json_extract(props,'$.k') as integer) ap from events)"""
MAP_SQL = """map_series as (select timestamp '2024-01-01 00:00:00' + to_hours(cast(vec_id*2 as integer)) epoch, -87.5 + 25.0*((k-1)//8) latitude, -180.0 + 45.0*((k-1)%8) longitude,
  case when (vec_id*64+k-1)%97=0 then null else round(20.0 + 40.0*cast(embedding[k] as double), 6) end tec_value, cast((k-1)//8 as integer) i, cast((k-1)%8 as integer) j
  from embeddings, range(1,65) t(k))"""
PAIRS_SQL = TRACK_SQL + ", p0 as (select *, rho_obs obs, 1e-12::double*exp(-(alt_km-450)/60) ref from track), density_pairs as (select *, ref*(1+0.001::double*(obs_id%200-100)) pred from p0)"
SERIES_SQL = "s as (select *, l_quantity::double as value, row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 rn from lineitem)"
GRID_SQL = "grid as (select a.i::int gi, b.j::int gj, -85.0::double + 5*a.i lat, -180.0::double + 5*b.j lon from range(35) a(i), range(72) b(j))"
DAILY_SQL = "index_daily as (select cast(o_orderdate as date) as day, ((sum(round(o_totalprice * 100)::bigint) * 10) // count(*))::double / 1e6::double f107 from orders group by 1)"
HOURLY_SQL = TRACK_SQL + ", index_hourly as (select date_trunc('hour', time) as time, avg(ap) ap from track where flag_dens=1 group by 1)"
THREE_SQL = TRACK_SQL + ", index_3h as (select to_timestamp(floor(epoch(time)/10800)*10800)::timestamp as time, avg(ap) ap from track group by 1)"
