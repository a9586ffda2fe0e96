"""Registered queries of features, grids, diagnostics and backtests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import backtest, grids, nearest, summaries, timeline
from ..sources import files, views
from .registry import FOLDS_SQL, MESH, A3, D, G, H, M, P, S, T, _model, _series, c, query, r6  # noqa: F401

SLOT = "to_timestamp(floor(epoch(time)/10800)*10800)::timestamp"
LST = """u as (select *, hour(time)+minute(time)/60.0::double+floor(second(time))/3600.0::double h from {0}), v as (select *, case when (h+lon/15)<0 then h+lon/15+24 else (h+lon/15)%24 end lst from u)"""


def _ntz(name: str):
    return c(name).cast("timestamp_ntz").alias(name)


@query(A3 + f""", k as (select unnest(generate_series(min(time), max(time), interval 3 hour)) as slot from index_3h), j as (select k.slot, ap from k left join index_3h i on i.time = k.slot), g as (select slot, ap, lag(ap,1) over (order by slot) a1 from j), {LST.format('track')}
select obs_id, round(sin(2*pi()*lst/24)*lat,6) lst_lat_sin, round(cos(2*pi()*lst/24)*lat,6) lst_lat_cos, round(g.ap-g.a1,6) ap_change from v left join g on g.slot={SLOT}""")
def interactions(spark, sf):
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("time") / 10800) * 10800)
    aps = timeline.ap_history(views.index_3h(spark, sf)).select(c("time").alias("slot"), "ap_0h", "ap_m3h")
    a, b = C.cyclic(C.local_solar_time(c("time"), c("lon")), 24)
    t = views.track(spark, sf).withColumn("slot", slot).join(aps, "slot", "left")
    made = C.interactions(c("lat"), a, b, c("ap_0h"), c("ap_m3h"))
    return t.select("obs_id", *[r6(x).alias(n) for n, x in made.items()])


DIAGNOSED = ["lat", "lon", "alt_km", "rho_obs", "flag_dens", "ap"]


@query(T + " union all ".join(f"select '{x}' as \"column\", count(*) n, count(*)-count({x}) nulls, min({x})::double lo, max({x})::double hi from track" for x in DIAGNOSED))
def column_diagnostics(spark, sf):
    return summaries.diagnostics(views.track(spark, sf), DIAGNOSED)


@query(P + ", x as (select obs v from density_pairs union all select pred from density_pairs) select round(min(v)*1e12,6) lo, round(max(v)*1e12,6) hi from x")
def shared_limits(spark, sf):
    lim = summaries.shared_limits(views.density_pairs(spark, sf).select("obs", "pred"))
    return lim.select(r6(c("lo") * 1e12).alias("lo"), r6(c("hi") * 1e12).alias("hi"))


@query(T + """, e as (select date_trunc('hour', min(time)) h from track), a as (select time::date as day, min(time)::timestamp first_time, max(time)::timestamp last_time, count(*) n_day from track group by 1)
select date_trunc('hour', time)::timestamp as hour, count(*) n, round(avg(alt_km),6) alt_km, round(avg(lat),6) lat, any_value(first_time) first_time, any_value(last_time) last_time, any_value(n_day) n_day from track, e, a where date_trunc('hour', time)=e.h and a.day=e.h::date group by 1""")
def hourly_altitude_lookup(spark, sf):
    t = views.track(spark, sf)
    first = t.agg(F.min("time").alias("t")).first()["t"]
    day = t.filter(F.to_date("time") == F.to_date(F.lit(first))).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count(F.lit(1)).alias("n_day"))
    row = summaries.at_hour(summaries.hourly_means(t), first).crossJoin(F.broadcast(day))
    return row.select(_ntz("hour"), "n", r6(c("alt_km")).alias("alt_km"), r6(c("lat")).alias("lat"), _ntz("first_time"), _ntz("last_time"), "n_day")


NUMERIC = ["obs_id", "lat", "lon_deg", "lon", "alt_km", "flag_dens", "ap"]


@query(T + "select date_trunc('hour', time)::timestamp as hour, count(*) n, " + ", ".join(f"round(avg({x}),6) {x}" for x in NUMERIC) + " from track group by 1")
def hourly_mean_all(spark, sf):
    return summaries.hourly_means(views.track(spark, sf)).select(_ntz("hour"), "n", *[r6(c(x)).alias(x) for x in NUMERIC])


@query(P + "select count(*) n, round(sqrt(avg(pow(pred-obs,2)))*1e12,6) rmse, round(avg(abs(pred-obs))*1e12,6) mae, round(avg(abs(pred-obs)/nullif(abs(obs),0))*100,6) mape_pct, round(avg(pred-obs)*1e12,6) bias from density_pairs where obs is not null")
def metrics_forecast(spark, sf):
    m = summaries.forecast_metrics(views.density_pairs(spark, sf), c("obs"), c("pred"))
    return m.select("n", *[r6(c(x) * 1e12).alias(x) for x in ("rmse", "mae", "bias")], r6(c("mape_pct")).alias("mape_pct"))


@query(P + ", x as (select ln(obs/ref) y, ln(pred/ref) p from density_pairs where obs>0) select round(sqrt(avg(pow(p-y,2))),6) rmse, round(avg(abs(p-y)),6) mae, round(1-sum(pow(p-y,2))/(var_pop(y)*count(*)),6) r2 from x")
def residual_metrics(spark, sf):
    m = summaries.metrics(views.density_pairs(spark, sf), C.log_ratio(c("obs"), c("ref")), C.log_ratio(c("pred"), c("ref")))
    return m.select(*[r6(c(x)).alias(x) for x in ("rmse", "mae", "r2")])


@query(P + """, x as (select obs, pred, ln(obs) lo, ln(pred) lp from density_pairs where obs>0 and ref>0 and pred>0),
k as (select *, row_number() over (order by abs(pred-obs) desc) a, row_number() over (order by abs(lp-lo) desc) b, greatest(1, ceil(0.05*count(*) over ())) m from x)
select round(sqrt(avg(pow(pred-obs,2)))*1e12,6) rmse, round(avg(abs(pred-obs)/obs)*100,6) mape_pct, round(corr(obs,pred),6) r, round(1-sum(pow(pred-obs,2))/(var_pop(obs)*count(*)),6) r2, round(avg(case when a<=m then abs(pred-obs) end)*1e12,6) top5,
round(sqrt(avg(pow(lp-lo,2))),6) rmse_log, round(corr(lo,lp),6) r_log, round(1-sum(pow(lp-lo,2))/(var_pop(lo)*count(*)),6) r2_log, round(avg(case when b<=m then abs(lp-lo) end),6) top5_log from k""")
def metrics_density(spark, sf):
    m = summaries.density_metrics(views.density_pairs(spark, sf), c("obs"), c("ref"), c("pred"))
    tiny = ("rmse", "top5")
    return m.select(*[r6(c(x) * 1e12 if x in tiny else c(x)).alias(x) for x in ("rmse", "mape_pct", "r", "r2", "top5", "rmse_log", "r_log", "r2_log", "top5_log")])


@query(H + ", k as (select unnest(generate_series(min(time), max(time), interval 1 hour)) as time from index_hourly) select k.time::timestamp as time, round(ap,6) ap from k left join index_hourly using (time)")
def index_densify(spark, sf):
    return timeline.densify(views.index_hourly(spark, sf), "time", "1 hour").select(_ntz("time"), r6(c("ap")).alias("ap"))


GRID_OF_TRACK = """b as (select floor(min(lat)/5)*5 a0, max(lat) a1, floor(min(lon)/5)*5 o0, max(lon) o1, date_trunc('hour', max(time)) h from track),
alt as (select round(avg(alt_km),6) alt_km from track, b where date_trunc('hour', time)=h),
g as (select i::int i, j::int j, a0+i*5.0::double lat, o0+j*5.0::double lon, h as time, alt_km from b, alt, range(40) x(i), range(80) y(j) where a0+i*5 < a1 and o0+j*5 < o1),
u as (select *, case when hour(time)+lon/15<0 then hour(time)+lon/15+24 else (hour(time)+lon/15)%24 end lst from g)"""


def _track_grid(spark, sf) -> DataFrame:
    """Cells of 5 degrees over the track's extent, at its last hour and that hour's mean altitude."""
    t = views.track(spark, sf)
    b = t.agg((F.floor(F.min("lat") / 5) * 5).cast("double").alias("a0"), F.max("lat").alias("a1"), (F.floor(F.min("lon") / 5) * 5).cast("double").alias("o0"), F.max("lon").alias("o1"), F.max("time").alias("t")).first()
    instant = summaries.at_hour(summaries.hourly_means(t), b["t"]).select(c("hour").alias("time"), r6(c("alt_km")).alias("alt_km"))
    return grids.at_instant(grids.lat_lon(spark, (b["a0"], b["a1"], 5.0), (b["o0"], b["o1"], 5.0)), instant)


@query(T + f", {GRID_OF_TRACK} select i, j, lat, lon, alt_km, " + "round(sin(2*pi()*lst/24),6) lst_sin, round(cos(2*pi()*lst/24),6) lst_cos, round(sin(2*pi()*dayofyear(time)/365),6) doy_sin, round(cos(2*pi()*dayofyear(time)/365),6) doy_cos, round(sin(2*pi()*lst/24)*lat,6) lst_lat_sin from u")
def grid_cross(spark, sf):
    return _track_grid(spark, sf).select("i", "j", "lat", "lon", "alt_km", *[r6(c(x)).alias(x) for x in ("lst_sin", "lst_cos", "doy_sin", "doy_cos", "lst_lat_sin")])


@query(M + ", e as (select max(epoch) e from map_series) select g.i::int i, h.j::int j, -87.5::double+25.0::double*g.i lat, -180.0::double+45.0::double*h.j lon, tec_value, tec_value vtec_lag from range(8) g(i) cross join range(9) h(j) left join (select * from map_series, e where epoch=e) m on m.i=g.i and m.j=h.j")
def grid_map_merge(spark, sf):
    maps = views.map_series(spark, sf)
    epoch = maps.agg(F.max("epoch").alias("e")).first()["e"]
    lat0, dlat, n_lat, lon0, dlon, n_lon = MESH
    # a column more than the maps have, as grids go on past 180 degrees: it has no map cell
    grid = grids.lat_lon(spark, (lat0, lat0 + n_lat * dlat, dlat), (lon0, lon0 + (n_lon + 1) * dlon, dlon))
    return grids.with_map(grid, maps, epoch).select("i", "j", "lat", "lon", "tec_value", "vtec_lag")


@query(P + "select obs_id, round(ref*exp(y)*1e12,6) log_residual_e12, round(exp(ly)*1e12,6) log_density_e12, round(pred*1e12,6) density_e12, round(ref*exp(pred)*1e12,6) legacy_e12 from (select *, ln(pred/ref) y, ln(pred) ly from density_pairs)")
def target_kinds(spark, sf):
    y, ref = C.log_ratio(c("pred"), c("ref")), c("ref")
    made = {"log_residual": (y, False), "log_density": (F.ln("pred"), False), "density": (c("pred"), False), "legacy": (c("pred"), True)}
    return views.density_pairs(spark, sf).select("obs_id", *[r6(C.target_density("density" if n == "legacy" else n, x, ref, old) * 1e12).alias(f"{n}_e12") for n, (x, old) in made.items()])


@query(A3 + """, k as (select unnest(generate_series(min(time), max(time), interval 3 hour)) as time from index_3h), j as (select k.time, ap from k left join index_3h using (time)),
g as (select time, ap, lag(ap,1) over w a1, lag(ap,2) over w a2, lag(ap,3) over w a3, case when count(ap) over (w rows between 11 preceding and 4 preceding)=8 then avg(ap) over (w rows between 11 preceding and 4 preceding) end m1, case when count(ap) over (w rows between 19 preceding and 12 preceding)=8 then avg(ap) over (w rows between 19 preceding and 12 preceding) end m2 from j window w as (order by time)),
d as (select time::date as day, avg(ap) ap_daily from index_3h group by 1), o as (select g.*, ap_daily from g left join d on d.day=g.time::date order by time desc limit 1)
select obs_id, round(ap_daily,6) a0, round(o.ap,6) a1, round(a1,6) a2, round(m2,6) a6, -1 as geo_mode from track, o""")
def instant_indices(spark, sf):
    names = ["ap_daily", "ap_0h", "ap_m3h", "ap_m6h", "ap_m9h", "ap_avg12_33h", "ap_avg36_57h"]
    last = files.newest(timeline.ap_history(views.index_3h(spark, sf)), ["time"], 1).select(C.ap_vector([c(n) for n in names]).alias("aps"))
    out = grids.with_indices(views.track(spark, sf), last)
    return out.select("obs_id", *[r6(c("aps")[i]).alias(f"a{k}") for k, i in ((0, 0), (1, 1), (2, 2), (6, 6))], C.geomagnetic_mode(c("aps")).alias("geo_mode"))


@query(T + "select obs_id, time::timestamp as time, lon, lat, alt_km, ap::double ap_first, ap::double ap_last, -1 as geo_mode from track")
def model_input(spark, sf):
    v = C.ap_vector(c("ap"))
    return views.track(spark, sf).select("obs_id", _ntz("time"), "lon", "lat", "alt_km", v[0].alias("ap_first"), v[6].alias("ap_last"), C.geomagnetic_mode(v).alias("geo_mode"))


@query(T + """, d as (select time::date as day, avg(ap) v from track where flag_dens=1 and dayofyear(time)%3<>0 group by 1), j as (select t.obs_id, t.time, d.v from track t left join d on d.day=t.time::date),
f as (select obs_id, last_value(v ignore nulls) over (order by time, obs_id rows between unbounded preceding and current row) v from j), b as (select arg_min(v, time) v from j where v is not null) select obs_id, round(coalesce(f.v, b.v),6) ap_daily from f, b""")
def daily_index_join(spark, sf):
    t = views.track(spark, sf).withColumn("day", F.to_date("time"))
    daily = t.filter("flag_dens = 1 and dayofyear(time) % 3 <> 0").groupBy("day").agg(F.avg("ap").alias("v"))
    j = t.join(daily, "day", "left").select("obs_id", "time", "v")
    return timeline.fill(j, F.to_date("time"), ["time", "obs_id"], ["v"]).select("obs_id", r6(c("v")).alias("ap_daily"))


@query(T + "select obs_id, alt_km from track where time >= (select max(time) - interval 2 days from track)")
def last_two_days(spark, sf):
    return timeline.last_days(views.track(spark, sf), 2).select("obs_id", "alt_km")


@query(FOLDS_SQL + ", k as (select distinct day from f join d on o >= s-5 and o < s where s=6+(select count(*)//2 from f)) select obs_id from track where time::date in (select day from k)")
def fold_members(spark, sf):
    t = views.track(spark, sf).withColumn("day", F.to_date("time"))
    plan = summaries.fold_plan(t.select("day").distinct(), 3)
    half = plan.select("fold").distinct().agg(F.expr("count(1) div 2").alias("fold"))
    days = plan.filter("role = 'train'").join(F.broadcast(half), "fold").select("day")
    return t.join(days, "day", "left_semi").select("obs_id")


@query(S + ", n as (select count(*) // 6 k from s), b as (select least(rn//k,5) block from s, n) select distinct block from b except select unnest([0,1,2,5])")
def val_blocks(spark, sf):
    s = _series(spark, sf).select("rn")
    size = s.count() // 6
    blocks = s.select(F.least(F.floor(c("rn") / size), F.lit(5)).cast("long").alias("block"), summaries.block_role(c("rn"), size * 6).alias("role"))
    return blocks.select("block").distinct().exceptAll(blocks.filter("role = 'train'").select("block").distinct())


@query(P + "select obs_id, obs, pred from density_pairs order by md5('42/' || obs_id::varchar), obs_id limit 1000")
def random_rows(spark, sf):
    return summaries.random_rows(views.density_pairs(spark, sf).select("obs_id", "obs", "pred"), ["obs_id"], 1000, seed=42)


@query(M + "select year(epoch)::int as \"year\", count(*) n, count(tec_value) n_values from map_series group by 1")
def map_counts(spark, sf):
    return files.yearly_counts(views.map_series(spark, sf))


@query(M + "select epoch::timestamp epoch, latitude::double latitude, longitude::double longitude, tec_value from map_series order by epoch desc, latitude desc, longitude desc limit 5")
def map_newest(spark, sf):
    return files.newest(views.map_series(spark, sf), ["epoch", "latitude", "longitude"], 5).select(_ntz("epoch"), "latitude", "longitude", "tec_value")


@query(P + ", y as (select ln(obs/ref) y, time from density_pairs where obs>0), l as (select min(y) a, max(y) b from y where time < timestamp '2024-01-24') select round(avg(2*(y-a)/(b-a)-1),6) base from y, l where time < timestamp '2024-01-24'")
def scaled_target_mean(spark, sf):
    d = views.density_pairs(spark, sf).filter("time < timestamp '2024-01-24'").select(C.log_ratio(c("obs"), c("ref")).alias("y"))
    return summaries.scale(d, summaries.scaler_fit(d, ["y"]), ["y"]).agg(r6(F.avg("y")).alias("base"))


@query(T + "select obs_id, lat, alt_km, rho_obs*1e12 rho_e12 from track where flag_dens=0 and rho_obs>0")
def nominal_positive(spark, sf):
    return views.track(spark, sf).filter((c("flag_dens") == 0) & C.positive(c("rho_obs"))).select("obs_id", "lat", "alt_km", (c("rho_obs") * 1e12).alias("rho_e12"))


EXPERIMENTS = T + """, p as (select *, time::date as day, 1e-12::double*exp(-(alt_km-450)/60) ref, rho_obs obs from track), periods as (select 'pre' period union all select 'post'),
pp as (select period, p.* from p, periods where (period='pre') = (time < timestamp '2024-01-16')), d as (select period, day, row_number() over (partition by period order by day)-1 o from (select distinct period, day from pp)), n as (select period, count(*) n from d group by 1),
f as (select n.period, h, unnest(generate_series(6, n-h)) s from n, (select unnest([1,3]) h)),
b as (select f.period, h, s, avg(ln(obs/ref)) shift from f join d on d.period=f.period and o>=s-5 and o<s join pp on pp.period=f.period and pp.day=d.day and obs>0 group by 1,2,3),
x as (select f.period, f.h, r.r, obs, ref*case when r.r=1 then exp(coalesce(shift,0)) else 1 end pred from f join d on d.period=f.period and o>=f.s and o<f.s+f.h join pp on pp.period=f.period and pp.day=d.day left join b on b.period=f.period and b.h=f.h and b.s=f.s, (select unnest([0,1]) r) r)
select 'dr' || r || '_' || period || '_h' || h tag, count(*) n, round(sqrt(avg(pow(pred-obs,2)))*1e12,6) rmse, round(avg(abs(pred-obs))*1e12,6) mae, round(avg(abs(pred-obs)/nullif(abs(obs),0))*100,6) mape_pct, round(avg(pred-obs)*1e12,6) bias from x where obs is not null group by 1"""


@query(EXPERIMENTS)
def experiment_summary(spark, sf):
    """The 2 x 2 x 2 experiments (retrain, period, horizon); retraining fits the mean log residual of the days before."""
    rows = views.density_pairs(spark, sf)
    split = F.lit("2024-01-16").cast("timestamp")
    found = None
    for period, part in (("pre", c("time") < split), ("post", c("time") >= split)):
        for horizon in (1, 3):
            for retrain in (False, True):
                scored = backtest.rolling_shift(rows.filter(part), horizon, retrain)
                one = scored.select("obs", "pred", F.lit(files.run_tag(retrain, period, horizon)).alias("tag"))
                found = one if found is None else found.union(one)
    m = summaries.forecast_metrics(found, c("obs"), c("pred"), ["tag"])
    return m.select("tag", "n", *[r6(c(x) * 1e12).alias(x) for x in ("rmse", "mae", "bias")], r6(c("mape_pct")).alias("mape_pct"))


@query()
def grid_predict(spark, sf):
    """The boosted model's density over the track's grid, by the features it was trained on."""
    from .registry import FEATURES

    ap = views.track(spark, sf).agg(F.avg("ap").alias("ap"))
    cells = _track_grid(spark, sf).crossJoin(F.broadcast(ap)).withColumn("ref", C.reference_density(c("alt_km")))
    out = _model(spark, sf).score(cells.dropna(subset=FEATURES))
    return out.select("i", "j", "lat", "lon", "prediction", C.target_density("log_residual", c("prediction"), c("ref")).alias("rho_pred"))
