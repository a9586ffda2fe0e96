"""Exchangeable providers of the reference density.

A provider is called with the columns of time, latitude, longitude and altitude (km) and gives a
Column. Three kinds: an expression (`exponential`), a table in altitude and local solar time
(`Profile`), and a Python model behind Arrow batches (`batched`), whose state is built once for each
worker. The first two stay in the JVM.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C

Provider = Callable[[Column, Column, Column, Column], Column]
Model = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
BATCH = 20_000


def exponential(time: Column, lat: Column, lon: Column, alt_km: Column) -> Column:
    """The default: an exponential atmosphere."""
    return C.reference_density(alt_km)


@dataclass(frozen=True)
class Profile:
    """Densities at nodes of altitude (km, rising) and local solar time (hours, rising, from 0; 24 is 0 again).

    Between nodes the logarithm is linear in both; beyond the lowest and highest node it goes on
    with the slope of the outermost interval. Densities are by altitude, then by time.
    """

    altitudes: tuple[float, ...]
    hours: tuple[float, ...]
    densities: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        rising = lambda x: all(a < b for a, b in itertools.pairwise(x))
        if len(self.altitudes) < 2 or not self.hours or not rising(self.altitudes) or not rising(self.hours) or self.hours[0] != 0 or self.hours[-1] >= 24:
            raise ValueError("nodes must rise: two altitudes at least, hours from 0 to below 24")
        if len(self.densities) != len(self.altitudes) or any(len(r) != len(self.hours) or min(r) <= 0 for r in self.densities):
            raise ValueError("a positive density for each node")

    def __call__(self, time: Column, lat: Column, lon: Column, alt_km: Column) -> Column:
        return self.at(C.local_solar_time(time, lon), alt_km)

    def at(self, lst: Column, alt_km: Column) -> Column:
        hours, logs = [*self.hours, 24.0], [[*map(float, np.log(r)), float(np.log(r[0]))] for r in self.densities]
        lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        place = lambda nodes, v: F.greatest(F.lit(1), F.least(F.lit(len(nodes) - 1), sum((F.when(v >= x, 1).otherwise(0) for x in nodes), F.lit(0))))
        i, j = place(self.altitudes, alt_km), place(hours, lst)
        part = lambda nodes, n, v: (v - F.element_at(lit(nodes), n)) / (F.element_at(lit(nodes), n + 1) - F.element_at(lit(nodes), n))
        u, v = part(self.altitudes, i, alt_km), part(hours, j, lst)
        flat, width = lit(itertools.chain(*logs)), len(hours)
        node = lambda a, b: F.element_at(flat, (a - 1) * width + b)
        low = node(i, j) * (1 - v) + node(i, j + 1) * v
        high = node(i + 1, j) * (1 - v) + node(i + 1, j + 1) * v
        return F.when(alt_km.isNotNull() & lst.isNotNull(), F.exp(low * (1 - u) + high * u))

    def model(self) -> Model:
        """The same as a Python model, for use with `batched`."""
        alts, hours = np.array(self.altitudes), np.array([*self.hours, 24.0])
        logs = np.log(np.array(self.densities))
        logs = np.column_stack([logs, logs[:, :1]])

        def run(us: np.ndarray, lat: np.ndarray, lon: np.ndarray, alt: np.ndarray) -> np.ndarray:
            lst = np.mod((us // 1_000_000 % 86_400) / 3600 + lon / 15, 24.0)
            with np.errstate(invalid="ignore"):
                i = np.clip(np.searchsorted(alts, alt, "right") - 1, 0, len(alts) - 2)
                j = np.clip(np.searchsorted(hours, lst, "right") - 1, 0, len(hours) - 2)
                u, v = (alt - alts[i]) / (alts[i + 1] - alts[i]), (lst - hours[j]) / (hours[j + 1] - hours[j])
                low = logs[i, j] * (1 - v) + logs[i, j + 1] * v
                high = logs[i + 1, j] * (1 - v) + logs[i + 1, j + 1] * v
                return np.exp(low * (1 - u) + high * u)

        return run


def batched(build: Callable[[], Model], batch: int = BATCH) -> Provider:
    """A Python model as a provider. build() runs once for each stream of batches in a worker; the model gets `batch` rows at most.

    The model is called with microseconds since 1970 (UTC), latitude, longitude and altitude as numpy
    arrays; a row with a null among them, or for which it gives NaN, has no density.
    """

    def run(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = build()
        for columns in parts:
            n, out = len(columns[0]), [np.zeros(0)]
            us = np.nan_to_num(columns[0].to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            missing = np.isnan(columns[0].to_numpy(zero_copy_only=False).astype(float))
            rest = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns[1:]]
            for k in range(0, n, batch):
                out.append(np.asarray(model(us[k : k + batch], *(r[k : k + batch] for r in rest)), float))
            found = np.concatenate(out)
            yield pa.array(found, pa.float64(), mask=missing | np.isnan(found))

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, "double")

    def provider(time: Column, lat: Column, lon: Column, alt_km: Column) -> Column:
        return made(F.unix_micros(time), lat.cast("double"), lon.cast("double"), alt_km.cast("double"))

    return provider


def transferred(provider: Provider, rho: Column, time: Column, lat: Column, lon: Column, source_km: Column, target_km: Column) -> Column:
    """Density at one altitude from that at another, by the provider's ratio."""
    return C.altitude_scaled(rho, provider(time, lat, lon, source_km), provider(time, lat, lon, target_km))
