"""Column functions: geometry, solar time, targets, losses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight distance on the unit sphere, rounded so that ties stay ties."""
    one, two = unit_xyz(lat1, lon1), unit_xyz(lat2, lon2)
    return F.round(F.sqrt(sum(((x - y) * (x - y) for x, y in zip(one, two, strict=True)), F.lit(0.0))), 9)


def bin_number(v: Column, start: float, step: float) -> Column:
    return F.floor((v - start) / step)


def bin_center(v: Column, start: float, step: float) -> Column:
    return start + (bin_number(v, start, step) + 0.5) * step


def utc_hours(t: Column) -> Column:
    """Hour, minute and whole second; fractions of a second are dropped."""
    return F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600


def of_day(hours: Column) -> Column:
    """Hours in a day of 24. A time before midnight by less than a double can tell from 24 is 24, not 0 (pmod folds that again)."""
    rest = hours % F.lit(24.0)
    return F.when(rest < 0, rest + 24).otherwise(rest)


def local_solar_time(t: Column, lon: Column) -> Column:
    return of_day(utc_hours(t) + lon / 15)


def cyclic(v: Column, period: float) -> tuple[Column, Column]:
    x = 2 * 3.141592653589793 * v / period
    return F.sin(x), F.cos(x)


def log_ratio(obs: Column, ref: Column) -> Column:
    """ln(obs / ref); null where either is not positive."""
    return F.when((obs > 0) & (ref > 0), F.ln(F.try_divide(obs, ref)))


def finite(*values: Column) -> Column:
    """Whether all values are numbers (not null, NaN or infinite)."""
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def positive(*values: Column) -> Column:
    """Whether all values are finite and above 0."""
    ok = finite(*values)
    for v in values:
        ok = ok & (v > 0)
    return F.coalesce(ok, F.lit(False))


def target_density(kind: str, y: Column, ref: Column, legacy: bool = False) -> Column:
    """Density of a prediction: log_residual is relative to ref, log_density and density are not.

    legacy treats density like log_residual.
    """
    if kind == "log_residual" or (kind == "density" and legacy):
        return ref * F.exp(y)
    if kind == "log_density":
        return F.exp(y)
    if kind == "density":
        return y
    raise ValueError(f"unknown target kind {kind!r}")


def interactions(lat: Column, lst_sin: Column, lst_cos: Column, ap_now: Column, ap_before: Column) -> dict[str, Column]:
    return {"lst_lat_sin": lst_sin * lat, "lst_lat_cos": lst_cos * lat, "ap_change": ap_now - ap_before}


def instant_features(t: Column, lon: Column, lat: Column, doy_period: float = 365, whole_hour: bool = True) -> dict[str, Column]:
    """Cyclic features of the grid variant: whole UTC hour and a year of 365 days unless told otherwise."""
    lst = of_day((F.hour(t).cast("double") if whole_hour else utc_hours(t)) + lon / 15)
    (a, b), (d, e) = cyclic(lst, 24), cyclic(F.dayofyear(t), doy_period)
    return {"lst_sin": a, "lst_cos": b, "doy_sin": d, "doy_cos": e, "lon_sin": F.sin(F.radians(lon)), "lon_cos": F.cos(F.radians(lon)), "lst_lat_sin": a * lat, "lst_lat_cos": b * lat}


def ap_vector(values: Column | list[Column]) -> Column:
    """Seven Ap values: those given, or one of them seven times."""
    return F.array(*[v.cast("double") for v in values]) if isinstance(values, list) else F.array_repeat(values.cast("double"), 7)


def geomagnetic_mode(aps: Column) -> Column:
    """-1 for a vector of seven values, else 1."""
    return F.when(F.size(aps) == 7, -1).otherwise(1)


def altitude_scaled(rho: Column, source: Column, target: Column, least: float = 1e-30) -> Column:
    """Density carried from the altitude of density `source` to that of density `target`."""
    return rho * (target / F.when(source.isNotNull(), F.greatest(source, F.lit(least))))


def observed_or_reference(df: DataFrame, observed: str, reference: str) -> Column:
    """The observed column if the table has one of that name, else the reference; neither is an error."""
    known = {c.lower() for c in df.columns}
    for name in (observed, reference):
        if name.lower() in known:
            return F.col(name)
    raise ValueError(f"neither {observed} nor {reference} in {df.columns}")


def threshold(value: str, zone: str | None = None) -> Column:
    """A time to compare with: text with its own offset, or wall time in `zone` (the session's where none is given)."""
    at = F.lit(value).cast("timestamp")
    has_offset = re.search(r"(?:Z|[+-]\d{2}:?\d{2})$", value.strip()) is not None
    return at if zone is None or has_offset else F.make_timestamp_ltz(*[f(F.lit(value).cast("timestamp_ntz")) for f in (F.year, F.month, F.day, F.hour, F.minute)], F.lit(value).cast("timestamp_ntz").substr(18, 9).cast("decimal(16,6)"), F.lit(zone))


def circular_mean(degrees: Column) -> Column:
    """Aggregate: mean direction in (-180, 180], which a plain mean of longitudes is not; null where there is none."""
    a, b = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.when(a * a + b * b > 1e-18, F.degrees(F.atan2(a, b)))


def number(x: Column) -> Column:
    """Trimmed text with a decimal point or comma; null where it is no number."""
    return F.trim(F.replace(x, F.lit(","), F.lit("."))).try_cast("double")


def reference_density(alt_km: Column, rho0: float = 1e-12, h0: float = 450.0, scale_km: float = 60.0) -> Column:
    """Default provider: an exponential atmosphere."""
    return rho0 * F.exp(-(alt_km - h0) / scale_km)


def mse_extreme(r: Column, lam: float, t: float) -> tuple[Column, Column]:
    return r + F.when(F.abs(r) > t, lam * F.signum(r)).otherwise(0.0), F.lit(2.0)


def pseudo_huber(r: Column, delta: float) -> tuple[Column, Column]:
    s = 1 + (r / delta) * (r / delta)
    return r / F.sqrt(s), 1 / (s * F.sqrt(s))


def pseudo_huber_extreme(r: Column, delta: float, lam: float, t: float) -> tuple[Column, Column]:
    g, h = pseudo_huber(r, delta)
    far = F.abs(r) > t
    return g + F.when(far, lam * F.signum(r)).otherwise(0.0), h + F.when(far, lam).otherwise(0.0)


def learning_rate(k: Column, base: float, decay: float, every: int, warm: int = 0) -> Column:
    return F.when(k < warm, 1e-7).otherwise(base * F.pow(F.lit(decay), F.floor(k / every)))
