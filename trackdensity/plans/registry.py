"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import providers
from ..operators import blocks, nearest, summaries, timeline
from ..sources import files, views

QUERIES: dict = {}
SQL: dict[str, str] = {}
MESH = (-87.5, 25.0, 8, -180.0, 45.0, 8)
MIN_POINTS = 64
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x):
    return F.round(x, 6)


T, M, P, S, G, D, H, A3 = (f"with {x} " for x in (views.TRACK_SQL, views.MAP_SQL, views.PAIRS_SQL, views.SERIES_SQL, views.GRID_SQL, views.DAILY_SQL, views.HOURLY_SQL, views.THREE_SQL))
TM = f"with {views.TRACK_SQL}, {views.MAP_SQL} "
DIST = "round(sqrt(pow(cos(radians(t.lat))*cos(radians(t.lon))-cos(radians(m.latitude))*cos(radians(m.longitude)),2)+pow(cos(radians(t.lat))*sin(radians(t.lon))-cos(radians(m.latitude))*sin(radians(m.longitude)),2)+pow(sin(radians(t.lat))-sin(radians(m.latitude)),2)),9)"
MATCH_SQL = f"""{TM}, m0 as (select t.obs_id, t.time, m.epoch, {DIST} dist, m.latitude, m.longitude, m.tec_value from track t join map_series m on t.time >= m.epoch - interval 3 hours and t.time < m.epoch + interval 3 hours),
m1 as (select *, row_number() over (partition by obs_id, epoch order by dist, latitude, longitude) q from m0), m2 as (select * from m1 where q=1),
best as (select *, row_number() over (partition by obs_id order by dist, abs(epoch(time)-epoch(epoch)), epoch, latitude, longitude) b from m2) """


def _matches(spark, sf):
    return nearest.nearest_on_mesh(views.track(spark, sf), views.map_series(spark, sf), *MESH, min_points=MIN_POINTS)


def _best(spark, sf):
    return nearest.best_on_mesh(views.track(spark, sf), views.map_series(spark, sf), *MESH, min_points=MIN_POINTS)


@query(MATCH_SQL + """, j as (select t.lat, t.rho_obs, 1e-12::double*exp(-(t.alt_km-450)/60) ref, b.tec_value from track t left join best b on t.obs_id=b.obs_id and b.b=1)
select (-90+(greatest(ceil((lat+90)/10),1)-0.5)*10)::double band, count(*) n, count(tec_value) matched, round(sqrt(avg(pow(case when rho_obs>0 then ln(ref/rho_obs) end,2))),6) rmse_log, round(avg(ref-rho_obs)*1e12,6) bias_e12 from j group by 1""")
def flagship_match_error(spark, sf, provider=providers.exponential):
    t = views.track(spark, sf)
    best = _best(spark, sf).select("obs_id", "tec_value")
    j = t.join(best, "obs_id", "left").withColumn("ref", provider(c("time"), c("lat"), c("lon"), c("alt_km")))
    band = -90 + (F.greatest(F.ceil((c("lat") + 90) / 10), F.lit(1)) - 0.5) * 10
    return j.groupBy(band.cast("double").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count("tec_value").alias("matched"), r6(F.sqrt(F.avg(F.pow(C.log_ratio(c("ref"), c("rho_obs")), 2)))).alias("rmse_log"), r6(F.avg(c("ref") - c("rho_obs")) * 1e12).alias("bias_e12"))


@query(T + "select obs_id, round(case when (lon_deg+180)%360<0 then (lon_deg+180)%360+360 else (lon_deg+180)%360 end-180,6)::double lon, round(alt_km*1000/1000,6) alt_km from track")
def geo_wrap_units(spark, sf):
    return views.track(spark, sf).select("obs_id", r6(C.wrap_lon(c("lon_deg"))).alias("lon"), r6(c("alt_km") * 1000 / 1000).alias("alt_km"))


@query(T + "select obs_id, floor((lat+90)/5)::bigint ci, round(-90+(floor((lat+90)/5)+0.5)*5,6)::double lat_c from track")
def bin_center(spark, sf):
    return views.track(spark, sf).select("obs_id", C.bin_number(c("lat"), -90, 5).alias("ci"), r6(C.bin_center(c("lat"), -90, 5)).alias("lat_c"))


@query(T + f"select obs_id, {DIST} dist from track t, (select 10.0::double latitude, 20.0::double longitude) m")
def chord_distance(spark, sf):
    return views.track(spark, sf).select("obs_id", C.chord(c("lat"), c("lon"), F.lit(10.0), F.lit(20.0)).alias("dist"))


@query(T + """, u as (select *, hour(time)+minute(time)/60.0::double+floor(second(time))/3600.0::double h, dayofyear(time) doy from track), v as (select *, case when (h+lon/15)<0 then h+lon/15+24 else (h+lon/15)%24 end lst from u)
select obs_id, round(lst,6) lst, round(sin(2*pi()*lst/24),6) lst_sin, round(cos(2*pi()*lst/24),6) lst_cos, round(sin(2*pi()*doy/366),6) doy_sin, round(cos(2*pi()*doy/366),6) doy_cos, round(sin(radians(lon)),6) lon_sin, round(cos(radians(lon)),6) lon_cos from v""")
def solar_time_rows(spark, sf):
    lst = C.local_solar_time(c("time"), c("lon"))
    (a, b), (d, e) = C.cyclic(lst, 24), C.cyclic(F.dayofyear("time"), 366)
    return views.track(spark, sf).select("obs_id", r6(lst).alias("lst"), r6(a).alias("lst_sin"), r6(b).alias("lst_cos"), r6(d).alias("doy_sin"), r6(e).alias("doy_cos"), r6(F.sin(F.radians("lon"))).alias("lon_sin"), r6(F.cos(F.radians("lon"))).alias("lon_cos"))


@query(P + "select obs_id, round(case when obs>0 then ln(obs/ref) end,6) log_ratio, round(ref*exp(ln(pred/ref))*1e12,6) back_e12, round(pred/nullif(obs,0),6) ratio, round((pred-obs)/nullif(obs,0),6) rel from density_pairs")
def log_ratio(spark, sf):
    return views.density_pairs(spark, sf).select("obs_id", r6(C.log_ratio(c("obs"), c("ref"))).alias("log_ratio"), r6(c("ref") * F.exp(C.log_ratio(c("pred"), c("ref"))) * 1e12).alias("back_e12"), r6(F.try_divide("pred", "obs")).alias("ratio"), r6(F.try_divide(c("pred") - c("obs"), c("obs"))).alias("rel"))


@query(MATCH_SQL + "select obs_id, epoch::timestamp epoch, dist, latitude::double latitude, longitude::double longitude, tec_value from best where b=1")
def nearest_cell_match(spark, sf):
    return _best(spark, sf).select("obs_id", c("epoch").cast("timestamp_ntz").alias("epoch"), "dist", "latitude", "longitude", "tec_value")


@query(MATCH_SQL + """, f as (select *, dist<0.2 near, last_value(case when dist<0.2 then {'v': tec_value} end ignore nulls) over (partition by epoch order by time, obs_id rows between unbounded preceding and 1 preceding) p from m2)
select obs_id, epoch::timestamp epoch, case when near then dist end dist, case when near then latitude end::double latitude, case when near then tec_value else p.v end tec_value, (not near)::int fallback_used from f where near or p is not null""")
def nearest_cell_fallback(spark, sf):
    out = nearest.with_fallback(_matches(spark, sf), 0.2)
    return out.select("obs_id", c("epoch").cast("timestamp_ntz").alias("epoch"), F.when(c("fallback_used") == 0, c("dist")).alias("dist"), "latitude", "tec_value", "fallback_used")


@query(TM + "select count(*) n, count(case when k is null then 1 end) empty from (select distinct epoch from map_series) e left join (select distinct m.epoch k from track t join (select distinct epoch from map_series) m on t.time >= m.epoch - interval 3 hours and t.time < m.epoch + interval 3 hours) on k=epoch")
def match_coverage(spark, sf):
    maps = views.map_series(spark, sf)
    used = nearest.epoch_pairs(views.track(spark, sf), maps, MIN_POINTS).select("epoch").distinct().withColumn("k", F.lit(1))
    return maps.select("epoch").distinct().join(used, "epoch", "left").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(c("k").isNull(), 1)).alias("empty"))


@query(T + "select date_trunc('hour', time)::timestamp as hour, round(avg(lat),6) lat, round(avg(lon),6) lon, round(avg(alt_km),6) alt_km, round(avg(rho_obs)*1e12,6) rho_e12, count(*) n from track group by 1")
def hourly_mean(spark, sf):
    return views.track(spark, sf).groupBy(F.date_trunc("hour", "time").cast("timestamp_ntz").alias("hour")).agg(*[r6(F.avg(x)).alias(x) for x in ("lat", "lon", "alt_km")], r6(F.avg("rho_obs") * 1e12).alias("rho_e12"), F.count(F.lit(1)).alias("n"))


@query(T + "select year(time)::int y, time::date as day, count(*) n, min(alt_km) lo, max(alt_km) hi, count(ap) n_ap from track group by 1, 2")
def daily_counts(spark, sf):
    return views.track(spark, sf).groupBy(F.year("time").alias("y"), F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("alt_km").alias("lo"), F.max("alt_km").alias("hi"), F.count("ap").alias("n_ap"))


@query(T + "select count(*) n, round(quantile_cont(alt_km,0.05),6) a05, round(quantile_cont(alt_km,0.95),6) a95, round(quantile_cont(lat,0.05),6) l05, round(quantile_cont(lat,0.95),6) l95, min(alt_km) lo, max(alt_km) hi from track")
def split_summary(spark, sf):
    t = views.track(spark, sf)
    q = summaries.column_quantiles(t, {"a": c("alt_km"), "l": c("lat")}, {"05": 0.05, "95": 0.95})
    one = t.agg(F.count(F.lit(1)).alias("n"), F.min("alt_km").alias("lo"), F.max("alt_km").alias("hi")).crossJoin(q)
    return one.select("n", *[r6(c(f"{x}_{p}")).alias(x + p) for x in "al" for p in ("05", "95")], "lo", "hi")


@query(P + """select count(*) "count", round(avg(pred-obs)*1e12,6) bias, round(avg(abs(pred-obs))*1e12,6) mae, round(sqrt(avg(pow(pred-obs,2)))*1e12,6) rmse, round(avg(case when obs>0 then abs(pred-obs)/obs end),6) mape,
round(1-sum(pow(pred-obs,2))/(var_pop(obs)*count(*)),6) r2, round(corr(obs,pred),6) corr, round(avg(case when obs>0 and pred>0 then pow(ln(pred)-ln(obs),2) end),6) mse_log from density_pairs where obs is not null""")
def metrics_validation(spark, sf):
    m = summaries.metrics(views.density_pairs(spark, sf), c("obs"), c("pred"))
    return m.select("count", *[r6(c(x) * 1e12).alias(x) for x in ("bias", "mae", "rmse")], *[r6(c(x)).alias(x) for x in ("mape", "r2", "corr", "mse_log")])


@query(P + "select round(avg(e),6) top5 from (select abs(ln(pred)-ln(obs)) e, row_number() over (order by abs(ln(pred)-ln(obs)) desc) k, count(*) over () n from density_pairs where obs>0 and pred>0) where k <= greatest(1, ceil(0.05*n))")
def top5pct(spark, sf):
    return summaries.top_share(views.density_pairs(spark, sf), F.abs(F.ln("pred") - F.ln("obs"))).select(r6(c("top5")).alias("top5"))


@query(P + "select round(quantile_cont(abs(pred-obs),0.95)*1e12,6) p95, round(exp(quantile_cont(case when obs>0 and pred>0 then abs(ln(pred)-ln(obs)) end,0.95)),6) factor from density_pairs")
def metrics_density_p95(spark, sf):
    q = summaries.column_quantiles(views.density_pairs(spark, sf), {"p": F.abs(c("pred") - c("obs")), "f": F.abs(F.ln("pred") - F.ln("obs"))}, {"95": 0.95})
    return q.select(r6(c("p_95") * 1e12).alias("p95"), r6(F.exp("f_95")).alias("factor"))


@query(P + "select (-90+(greatest(ceil((lat+90)/10),1)-0.5)*10)::double band, round(median(pred-obs)*1e12,6) median, count(*) n from density_pairs group by 1")
def lat_band_median(spark, sf):
    return summaries.lat_bands(views.density_pairs(spark, sf), c("pred") - c("obs")).select(c("band").cast("double").alias("band"), r6(c("median") * 1e12).alias("median"), "n")


@query(P + ", l as (select min(alt_km) lo, max(alt_km) hi from density_pairs) select case when obs>2e-12 then 'above' else 'below' end side, least(19, floor((alt_km-lo)/(hi-lo)*20))::bigint bin, count(*) n from density_pairs, l group by 1, 2")
def hist_shared_edges(spark, sf):
    return summaries.histogram(views.density_pairs(spark, sf), c("alt_km"), 20, F.when(c("obs") > 2e-12, "above").otherwise("below"))


@query(P + ", p1 as (select obs, pred from density_pairs where obs>0 and pred>0), l as (select min(obs) a, max(obs) b, min(pred) d, max(pred) e from p1) select least(999, floor((obs-a)/(b-a)*1000))::bigint bx, least(999, floor((pred-d)/(e-d)*1000))::bigint \"by\", count(*) n from p1, l group by 1, 2")
def hist2d(spark, sf):
    return summaries.histogram2d(views.density_pairs(spark, sf), c("obs"), c("pred"), 1000)


def _hexbin(gridsize: int):
    ny = int(gridsize / 3**0.5)

    def run(spark, sf):
        return summaries.hexbin_grid(views.density_pairs(spark, sf), c("lon"), c("lat"), gridsize)

    run.__name__ = "hexbin" if gridsize == 40 else f"hexbin_{gridsize}"
    return query(P + f""", l as (select min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 from density_pairs), q as (select (lon-x0)/(x1-x0)*{gridsize} x, (lat-y0)/(y1-y0)*{ny} y from density_pairs, l), z as (select *, pow(x-floor(x+0.5),2)+3*pow(y-floor(y+0.5),2) < pow(x-floor(x)-0.5,2)+3*pow(y-floor(y)-0.5,2) near from q)
select case when near then 0 else 1 end lattice, case when near then floor(x+0.5) else floor(x) end::bigint a, case when near then floor(y+0.5) else floor(y) end::bigint b, count(*) n from z group by 1,2,3""")(run)


_hexbin(40)
_hexbin(440)


@query(P + "select floor((lat+90)/5)::bigint bi, floor((lon+180)/5)::bigint bj, round(avg(pred)*1e12,6) mean, count(*) n from density_pairs group by 1,2")
def binned_map(spark, sf):
    return summaries.binned_map(views.density_pairs(spark, sf), c("pred"), 5).select("bi", "bj", r6(c("mean") * 1e12).alias("mean"), "n")


@query(P + "select x, round(sum(exp(-pow((x-alt_km)/5,2)/2))/(count(*)*5*sqrt(2*pi())),6) density from density_pairs, (select unnest([450,460,470,480,490,500])::double x) group by 1")
def kde(spark, sf):
    return summaries.kde(views.density_pairs(spark, sf), c("alt_km"), [450, 460, 470, 480, 490, 500], 5).select("x", r6(c("density")).alias("density"))


@query(P + "select case when alt_km>470 then 'above' else 'below' end side, count(*) n, round(avg(obs)*1e12,6) mean_e12 from density_pairs group by 1")
def threshold_split_value(spark, sf):
    return views.density_pairs(spark, sf).groupBy(F.when(c("alt_km") > 470, "above").otherwise("below").alias("side")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("obs") * 1e12).alias("mean_e12"))


@query(P + "select case when time>=timestamp '2024-01-15' then 'after' else 'before' end side, count(*) n from density_pairs group by 1")
def threshold_split_time(spark, sf):
    return views.density_pairs(spark, sf).groupBy(F.when(c("time") >= F.lit("2024-01-15").cast("timestamp"), "after").otherwise("before").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(D + ", k as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from index_daily), j as (select k.day, f107 from k left join index_daily using (day)), f as (select day, last_value(f107 ignore nulls) over (order by day rows between unbounded preceding and current row) f107 from j) select day, round(f107,9) f107 from f")
def index_fill(spark, sf):
    d = timeline.densify(views.index_daily(spark, sf), "day", "1 day")
    return timeline.fill(d, F.trunc("day", "month"), ["day"], ["f107"]).select("day", F.round("f107", 9).alias("f107"))


@query(D + ", k as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from index_daily), j0 as (select k.day, round(f107*1e6::double)::bigint m from k left join index_daily using (day)) select day, ((sum(m) over w) // (count(m) over w))::double / 1e6::double f107a from j0 window w as (order by day rows between 40 preceding and 40 following)")
def flux_81d(spark, sf):
    # whole millionths, so that the order of summation does not matter
    daily = views.index_daily(spark, sf).withColumn("f107", F.round(c("f107") * 1e6).cast("long"))
    return timeline.centred_mean(daily, "day", "f107", 40, "f107a").select("day", (F.floor("f107a").cast("double") / 1e6).alias("f107a"))


@query(H + ", k as (select unnest(generate_series(min(time), max(time), interval 1 hour)) as time from index_hourly), j as (select k.time, ap from k left join index_hourly using (time)), f as (select time, coalesce(last_value(ap ignore nulls) over (order by time rows between unbounded preceding and current row), 0) ap from j), g as (select time, ap, lag(ap,3) over (order by time) l3, lag(ap,24) over (order by time) l24 from f) select time::timestamp as time, round(ap,6) ap, round(l3,6) ap_lag3, round(l24,6) ap_lag24 from g")
def hourly_lag(spark, sf):
    d = timeline.fill(timeline.densify(views.index_hourly(spark, sf), "time", "1 hour"), F.to_date("time"), ["time"], ["ap"])
    out = timeline.time_lag(d, "time", "ap", [3, 24])
    return out.select(c("time").cast("timestamp_ntz").alias("time"), *[r6(c(x)).alias(x) for x in ("ap", "ap_lag3", "ap_lag24")])


@query(H + """, j as (select t.obs_id, t.time, i.ap v from track t left join index_hourly i on i.time = date_trunc('hour', t.time)), f as (select obs_id, last_value(v ignore nulls) over (order by time, obs_id rows between unbounded preceding and current row) v from j),
b as (select arg_min(v, time) v from j where v is not null) select obs_id, round(coalesce(f.v, b.v),6) ap_filled from f, b""")
def hourly_index_join(spark, sf):
    t = views.track(spark, sf).withColumn("h", F.date_trunc("hour", "time"))
    j = t.join(views.index_hourly(spark, sf).select(c("time").alias("h"), c("ap").alias("v")), "h", "left").select("obs_id", "time", "v")
    return timeline.fill(j, F.to_date("time"), ["time", "obs_id"], ["v"]).select("obs_id", r6(c("v")).alias("ap_filled"))


@query(D + f", {views.HOURLY_SQL}" + ", h as (select time::date as day, avg(ap) ap from index_hourly group by 1) select coalesce(d.day, h.day) as day, round(f107,9) f107, round(ap,6) ap from index_daily d full join h on d.day=h.day")
def index_outer_align(spark, sf):
    h = views.index_hourly(spark, sf).groupBy(F.to_date("time").alias("day")).agg(F.avg("ap").alias("ap"))
    return views.index_daily(spark, sf).join(h, "day", "full").select("day", F.round("f107", 9).alias("f107"), r6(c("ap")).alias("ap"))


@query(D + ", h as (select (day + to_hours(k))::timestamp as time, f107 from index_daily, range(24) t(k)) select time, round(f107,9) f107 from h")
def daily_to_hourly(spark, sf):
    return views.index_daily(spark, sf).select(F.explode(F.expr("sequence(cast(day as timestamp), cast(day as timestamp) + interval 23 hours, interval 1 hour)")).alias("time"), F.round("f107", 9).alias("f107")).select(c("time").cast("timestamp_ntz").alias("time"), "f107")


@query(A3 + """, k as (select unnest(generate_series(min(time), max(time), interval 3 hour)) as time from index_3h), j as (select k.time, ap from k left join index_3h using (time)),
g as (select time, ap, lag(ap,1) over w a1, lag(ap,3) over w a3, case when count(ap) over (w rows between 11 preceding and 4 preceding)=8 then avg(ap) over (w rows between 11 preceding and 4 preceding) end m1, case when count(ap) over (w rows between 19 preceding and 12 preceding)=8 then avg(ap) over (w rows between 19 preceding and 12 preceding) end m2 from j window w as (order by time)),
d as (select time::date as day, avg(ap) ap_daily from index_3h group by 1)
select g.time::timestamp as time, round(ap_daily,6) ap_daily, round(ap,6) ap_0h, round(a1,6) ap_m3h, round(a3,6) ap_m9h, round(m1,6) ap_avg12_33h, round(m2,6) ap_avg36_57h from g left join d on d.day=g.time::date""")
def ap_history(spark, sf):
    return timeline.ap_history(views.index_3h(spark, sf)).select(c("time").cast("timestamp_ntz").alias("time"), *[r6(c(x)).alias(x) for x in ("ap_daily", "ap_0h", "ap_m3h", "ap_m9h", "ap_avg12_33h", "ap_avg36_57h")])


def _series(spark, sf):
    return timeline.row_number(views.long_series(spark, sf), F.trunc("l_shipdate", "week"), views.SERIES_ORDER)


@query(S + "select rn, value from s")
def row_number(spark, sf):
    return _series(spark, sf).select(c("rn").cast("long").alias("rn"), "value")


def _lagged(k: int):
    def run(spark, sf):
        s = _series(spark, sf).select("rn", "value")
        return timeline.row_lag(s, "value", k, "lagged").select(c("rn").cast("long").alias("rn"), "value", "lagged")

    run.__name__ = f"row_lag_{k}"
    return query(S + f"select rn, value, lag(value, {k}) over (order by rn) lagged from s")(run)


_lagged(500)
_lagged(17280)


@query(S + "select rn, round(avg(abs(value-25)) over (order by rn rows between 49999 preceding and current row),6) mae from s")
def rolling_mae(spark, sf):
    s = _series(spark, sf).select("rn", "value")
    return timeline.rolling_mean(s, F.abs(c("value") - 25), 50_000, "mae").select(c("rn").cast("long").alias("rn"), r6(c("mae")).alias("mae"))


@query(S + "select rn, value from s where rn % 20 = 0")
def every_kth(spark, sf):
    return _series(spark, sf).filter("rn % 20 = 0").select(c("rn").cast("long").alias("rn"), "value")


@query(S + "select rn, value from s where rn >= 1000 and rn < 1500")
def row_slice(spark, sf):
    return _series(spark, sf).filter("rn >= 1000 and rn < 1500").select(c("rn").cast("long").alias("rn"), "value")


@query(M + "select i, j, epoch::timestamp epoch, tec_value, lag(tec_value,1) over w lag1, lag(tec_value,24) over w lag24 from map_series window w as (partition by i, j order by epoch)")
def cell_lag(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("i", "j").orderBy("epoch")
    return views.map_series(spark, sf).select("i", "j", c("epoch").cast("timestamp_ntz").alias("epoch"), "tec_value", F.lag("tec_value", 1).over(w).alias("lag1"), F.lag("tec_value", 24).over(w).alias("lag24"))


@query(T + ", b as (select obs_id, time, case when abs(lon-lag(lon) over (order by time, obs_id))>180 then 1 else 0 end k from track), g as (select sum(k) over (order by time, obs_id)::bigint segment from b) select segment, count(*) n from g group by 1")
def track_segments(spark, sf):
    out = timeline.segments(views.track(spark, sf), F.to_date("time"), ["time", "obs_id"])
    return out.groupBy(c("segment").cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(G + f", {views.TRACK_SQL}, g as (select *, floor((lat+90)/5)::bigint ci, floor((lon+180)/5)::bigint cj from grid), p as (select *, floor((lat+90)/5)::bigint ci, floor((lon+180)/5)::bigint cj from track) select obs_id, p.ci, p.cj, gi gi_grid from p left join g on p.ci=g.ci and p.cj=g.cj")
def collocate(spark, sf):
    return nearest.collocate(views.track(spark, sf), views.grid(spark), ["gi"], 5.0).select("obs_id", "ci", "cj", "gi_grid")


@query(TM + """, q as (select obs_id, lat, lon, (lat+87.5)/25 y, (lon+180)/45 x from track), k as (select obs_id, a, b, (floor(y)+a)::int i, (floor(x)+b)::int j, (case when a=1 then y-floor(y) else 1-(y-floor(y)) end)*(case when b=1 then x-floor(x) else 1-(x-floor(x)) end) w from q, range(2) ta(a), range(2) tb(b)),
e as (select * from map_series where epoch = timestamp '2024-01-05 00:00:00'), n as (select k.*, e.tec_value v from k left join e on e.i=k.i and e.j=k.j where w>0) select obs_id, round(case when count(*)=count(v) then coalesce(max(case when a=0 and b=0 then w*v end),0)+coalesce(max(case when a=0 and b=1 then w*v end),0)+coalesce(max(case when a=1 and b=0 then w*v end),0)+coalesce(max(case when a=1 and b=1 then w*v end),0) end,9) as value from n group by 1""")
def map_interpolate(spark, sf):
    maps = views.map_series(spark, sf).filter("epoch = timestamp '2024-01-05 00:00:00'")
    return nearest.interpolate(views.track(spark, sf).select("obs_id", "lat", "lon"), maps, -87.5, 25.0, -180.0, 45.0).select("obs_id", F.round("value", 9).alias("value"))


@query(T + "select obs_id, round(rho_obs*(exp(-(400-450)/60.0::double)/greatest(1e-12::double*exp(-(alt_km-450)/60),1e-30::double)*1e-12::double)*1e12,6) scaled_e12 from track")
def altitude_transfer(spark, sf, provider=providers.exponential):
    moved = providers.transferred(provider, c("rho_obs"), c("time"), c("lat"), c("lon"), c("alt_km"), F.lit(400.0))
    return views.track(spark, sf).select("obs_id", r6(moved * 1e12).alias("scaled_e12"))


@query(S + """, n as (select count(*) n, least(greatest((0.6*count(*))::bigint,1),count(*)-2) b1 from s), m as (select *, least(greatest(floor(0.8::double*n)::bigint, b1+1), n-1) b2 from n) select case when rn<b1 then 'train' when rn<b2 then 'next' else 'last' end role, count(*) n, min(rn) a, max(rn) b from s, m group by 1""")
def split_single(spark, sf):
    s = _series(spark, sf).select("rn")
    return s.withColumn("role", summaries.roles(summaries.single_split(s.count(), 0.6, 0.2), c("rn"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("rn").cast("long").alias("a"), F.max("rn").cast("long").alias("b"))


# sizes of a cycle's blocks (a, b, e) with gaps g, whole cycles q of period p, and the blocks of what is left (ra, rb, re)
@query(S + """, n0 as (select count(*) n from s), n1 as (select n, round_even(1100*n/60000.0::double, 0)::bigint g, greatest(1, round_even((2.0::double/3)*n/8, 0))::bigint a, greatest(1, round_even((1.0::double/6)*n/8, 0))::bigint b from n0),
n2 as (select *, b e, a+b+b+2*g p from n1), n3 as (select *, least(8, n//p) q from n2), n4 as (select *, n-q*p r, greatest(1, a*(n-q*p)//p) ra, greatest(1, b*(n-q*p)//p) rb from n3),
n5 as (select *, least(greatest(1, e*r//p), r-2*g-ra-rb) re from n4), x as (select rn, rn < q*p whole, case when rn < q*p then rn%p else rn-q*p end k, n5.* from s, n5),
y as (select rn, case when whole and k < a then 'train' when whole and k >= a+g and k < a+g+b then 'next' when whole and k >= a+2*g+b then 'last'
  when not whole and q < 8 and re > 0 and k < ra then 'train' when not whole and q < 8 and re > 0 and k >= ra+g and k < ra+g+rb then 'next' when not whole and q < 8 and re > 0 and k >= ra+2*g+rb and k < ra+2*g+rb+re then 'last' end role from x)
select role, count(*) n, min(rn) a, max(rn) b from y group by 1""")
def split_cyclic(spark, sf):
    # the gaps are fixed for the size of the 60,000-row series and follow it in proportion elsewhere
    s = _series(spark, sf).select("rn")
    n = s.count()
    gap = round(1100 * n / 60000)
    role = summaries.cyclic_role(c("rn"), n, 8, (2 / 3, 1 / 6, 1 / 6), (gap, gap))
    return s.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.min("rn").cast("long").alias("a"), F.max("rn").cast("long").alias("b"))


@query(S + ", n as (select count(*) // 6 k from s) select case when least(rn//k,5) in (0,1,2,5) then 'train' else 'val' end role, count(*) n from s, n group by 1")
def split_blocks6(spark, sf):
    s = _series(spark, sf).select("rn")
    return s.groupBy(summaries.block_role(c("rn"), s.count()).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(T + ", l as (select min(alt_km) a, max(alt_km) b, min(lat) d, max(lat) e from track where time < timestamp '2024-01-20') select obs_id, round(2*(alt_km-a)/(b-a)-1,6) alt_km, round(2*(lat-d)/(e-d)-1,6) lat from track, l")
def minmax_scale(spark, sf):
    t = views.track(spark, sf).select("obs_id", "time", "alt_km", "lat")
    return summaries.scale(t, summaries.scaler_fit(t.filter("time < timestamp '2024-01-20'"), ["alt_km", "lat"]), ["alt_km", "lat"]).select("obs_id", r6(c("alt_km")).alias("alt_km"), r6(c("lat")).alias("lat"))


@query(T + "select obs_id, round(alt_km,6) alt_km, round(lat,6) lat from track")
def minmax_inverse(spark, sf):
    t = views.track(spark, sf).select("obs_id", "alt_km", "lat")
    p = summaries.scaler_fit(t, ["alt_km", "lat"])
    return summaries.unscale(summaries.scale(t, p, ["alt_km", "lat"]), p, ["alt_km", "lat"]).select("obs_id", r6(c("alt_km")).alias("alt_km"), r6(c("lat")).alias("lat"))


@query(P + ", r as (select obs_id, case when obs>0 then ln(pred/obs) end r from density_pairs), s as (select *, 1+pow(r/0.5,2) s from r) select obs_id, round(r+case when abs(r)>1 then 0.3*sign(r) else 0 end,6) g1, round(r/sqrt(s),6) g2, round(1/(s*sqrt(s)),6) h2, round(1/(s*sqrt(s))+case when abs(r)>1 then 0.3 else 0 end,6) h3 from s")
def loss_gradients(spark, sf):
    r = C.log_ratio(c("pred"), c("obs"))
    g2, h2 = C.pseudo_huber(r, 0.5)
    return views.density_pairs(spark, sf).select("obs_id", r6(C.mse_extreme(r, 0.3, 1.0)[0]).alias("g1"), r6(g2).alias("g2"), r6(h2).alias("h2"), r6(C.pseudo_huber_extreme(r, 0.5, 0.3, 1.0)[1]).alias("h3"))


@query(S + """, k as (select rn % 1360 rn, sum(value) total from s group by 1)
select rn, total, round(5e-4::double*pow(0.8::double, rn//15)*1e6,6) a, round(5e-3::double*pow(0.8::double, rn//60)*1e6,6) b, round(case when rn<4 then 1e-7::double else 0.03::double*pow(0.9::double, rn//12) end*1e6,6) d from k""")
def lr_schedules(spark, sf):
    """The three schedules over the rounds that the series' rows are dealt to in turn, with each round's total."""
    k = _series(spark, sf).groupBy(F.pmod("rn", F.lit(1360)).cast("long").alias("rn")).agg(F.sum("value").alias("total"))
    out = [C.learning_rate(c("rn"), 5e-4, 0.8, 15), C.learning_rate(c("rn"), 5e-3, 0.8, 60), C.learning_rate(c("rn"), 0.03, 0.9, 12, 4)]
    return k.select("rn", "total", *[r6(x * 1e6).alias(n) for x, n in zip(out, "abd", strict=True)])


FOLDS_SQL = T + ", d as (select time::date as day, row_number() over (order by time::date)-1 o from (select distinct time::date::timestamp as time from track)), n as (select count(*) n from d), f as (select unnest(generate_series(6, n-3)) s from n) "


@query(FOLDS_SQL + "select (s-6)::bigint fold, floor((s-2)/7)::bigint segment, case when o<s then 'train' else 'forecast' end role, day from f join d on o >= s-5 and o < s+3")
def fold_plan(spark, sf):
    days = views.track(spark, sf).select(F.to_date("time").alias("day")).distinct()
    return summaries.fold_plan(days, 3)


@query(FOLDS_SQL + """, x as (select f.s-6 fold, p.obs, p.ref from f join d on o>=s and o<s+3 join (select *, 1e-12::double*exp(-(alt_km-450)/60) ref, rho_obs obs from track) p on p.time::date=d.day)
select fold::bigint fold, count(*) n, round(sqrt(avg(pow(ref-obs,2)))*1e12,6) rmse, round(avg(abs(ref-obs))*1e12,6) mae, round(avg(abs(ref-obs)/nullif(abs(obs),0))*100,6) mape_pct, round(avg(ref-obs)*1e12,6) bias from x where obs is not null group by 1""")
def backtest_baseline_summary(spark, sf):
    p = views.density_pairs(spark, sf).withColumn("day", F.to_date("time"))
    plan = summaries.fold_plan(p.select("day").distinct(), 3).filter("role = 'forecast'")
    m = summaries.forecast_metrics(p.join(plan, "day"), c("obs"), c("ref"), ["fold"])
    return m.select("fold", "n", *[r6(c(x) * 1e12).alias(x) for x in ("rmse", "mae")], r6(c("mape_pct")).alias("mape_pct"), r6(c("bias") * 1e12).alias("bias"))


@query("""select page_id, case when starts_with(lower(ltrim(substr(html,1,64))),'<!') or starts_with(lower(ltrim(substr(html,1,64))),'<html') then 'html' when strlen(html)<2000 then 'tiny' when starts_with(html, '     1.0') then 'plain' else 'other' end kind, strlen(html)::bigint n from (select page_id, html from pages union all select -1-doc_id, coalesce(text,'') from documents)""")
def payload_kind(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((-1 - c("doc_id")).alias("page_id"), F.coalesce("text", F.lit("")).alias("html"))
    raw = c("html").cast("binary")
    return pages.union(docs).select("page_id", files.payload_kind(raw).alias("kind"), F.octet_length("html").cast("long").alias("n"))


@query(T + "select date_trunc('second', time)::timestamp as time, round(alt_km,4) alt_km, round(case when (lon_deg+180)%360<0 then (lon_deg+180)%360+360 else (lon_deg+180)%360 end-180,4)::double lon, round(lat,4)::double lat, round(rho_obs*1e12,6) rho_e12 from track where flag_dens=0")
def track_text_parse(spark, sf):
    t = views.track(spark, sf)
    line = F.format_string("%s %s UTC %.4f %.4f %.4f 0.0 0.0 %.17e 0.0 %d 0 # row", F.date_format("time", "yyyy-MM-dd"), F.date_format("time", "HH:mm:ss"), c("alt_km") * 1000, "lon_deg", "lat", "rho_obs", "flag_dens")
    out = files.parse_track_lines(t.select(line.alias("value")))
    return out.select(c("time").cast("timestamp_ntz").alias("time"), F.round("alt_km", 4).alias("alt_km"), F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), r6(c("rho_obs") * 1e12).alias("rho_e12"))


@query("select event_id, try_cast(replace(trim(case when event_id%3=0 then ' ' || replace(cast(event_id/8.0::double as varchar),'.',',') when event_id%3=1 then 'x' || event_id else cast(event_id as varchar) end),',','.') as double) v from events")
def lenient_number(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    text = F.when(c("event_id") % 3 == 0, F.concat(F.lit(" "), F.replace((c("event_id") / 8.0).cast("string"), F.lit("."), F.lit(",")))).when(c("event_id") % 3 == 1, F.concat(F.lit("x"), c("event_id").cast("string"))).otherwise(c("event_id").cast("string"))
    return e.select("event_id", C.number(text).alias("v"))


FEATURES = ["lat", "alt_km", "lst_sin", "lst_cos", "lon_sin", "lon_cos", "ap"]


def _rows(spark, sf):
    """Rows with all features as columns and the target (no vector, whose assembly took most of a pass)."""
    a, b = C.cyclic(C.local_solar_time(c("time"), c("lon")), 24)
    d = views.density_pairs(spark, sf).withColumns({"lst_sin": a, "lst_cos": b, "lon_sin": F.sin(F.radians("lon")), "lon_cos": F.cos(F.radians("lon")), "ap": c("ap").cast("double"), "y": C.log_ratio(c("obs"), c("ref"))})
    return d.dropna(subset=[*FEATURES, "y"]).withColumn("is_valid", c("time") >= F.lit("2024-01-24").cast("timestamp"))


_fitted: dict[tuple[str, str], object] = {}


def _model(spark, sf):
    """The boosted model of a folder's rows, fitted once for an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        rate = lambda k: 0.1 if k else 1.0
        _fitted[key], _ = blocks.boost(_rows(spark, sf), FEATURES, "y", c("is_valid"), ["obs_id"], blocks.squared, rate, 1360, sample=0.5, share=0.6)
    return _fitted[key]


@query()
def gbt_train_score(spark, sf):
    out = _model(spark, sf).score(_rows(spark, sf).filter("is_valid"))
    return out.select("obs_id", "y", "prediction", C.target_density("log_residual", c("prediction"), c("ref")).alias("rho_pred"))


@query()
def feature_importance(spark, sf):
    """The features by gain, 15 at most."""
    gains = sorted(_model(spark, sf).importances().items(), key=lambda x: -x[1])[:15]
    return spark.createDataFrame([(n, float(v)) for n, v in gains], "feature string, gain double")


@query()
def newton_boost_curve(spark, sf):
    f = _rows(spark, sf)
    rate = lambda k: 0.3 * 0.9 ** (k // 12)
    _, curve = blocks.boost(f, FEATURES, "y", c("is_valid"), ["obs_id"], blocks.pseudo_huber, rate, 1360, mean_first=True)
    rows = spark.createDataFrame(curve, "round int, train_rmse double, valid_rmse double")
    return rows.withColumn("rate", C.learning_rate(c("round"), 0.3, 0.9, 12))
