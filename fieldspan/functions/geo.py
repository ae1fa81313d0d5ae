"""Column expressions for a local plane and for distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspan.model import EARTH_A, EARTH_E2, M2_PER_HA


def metres_per_degree(lat0: Column) -> tuple[Column, Column]:
    """Of latitude and of longitude, from the meridional and prime-vertical radii at ``lat0``."""
    s = F.sin(F.radians(lat0))
    w = 1 - F.lit(EARTH_E2) * s * s
    meridional = F.lit(EARTH_A * (1 - EARTH_E2)) / (w * F.sqrt(w))
    vertical = F.lit(EARTH_A) / F.sqrt(w)
    return F.radians(F.lit(1.0)) * meridional, F.radians(F.lit(1.0)) * vertical * F.cos(F.radians(lat0))


def forward(lat: Column, lon: Column, lat0: Column, lon0: Column, m_lat: Column, m_lon: Column) -> tuple[Column, Column]:
    """x (east) and y (north) in metres."""
    return (lon - lon0) * m_lon, (lat - lat0) * m_lat


def inverse(x: Column, y: Column, lat0: Column, lon0: Column, m_lat: Column, m_lon: Column) -> tuple[Column, Column]:
    """lat and lon."""
    return lat0 + y / m_lat, lon0 + x / m_lon


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.sin((b - a) / 2)
    turn = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    inside = half * half + F.cos(a) * F.cos(b) * turn * turn
    return F.lit(2 * EARTH_A) * F.asin(F.sqrt(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))))


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def speed(dist: Column, dt: Column) -> Column:
    return F.when(dt > 0, dist / dt).otherwise(F.lit(0.0))


def kmh(ms: Column) -> Column:
    return ms * 3.6


def hectares(m2: Column) -> Column:
    return m2 / M2_PER_HA


def share(part: Column, whole: Column) -> Column:
    """In percent; 0 of nothing."""
    return F.when(whole > 0, 100 * part / whole).otherwise(F.lit(0.0))


def rate(amount: Column, whole: Column) -> Column:
    """0 of nothing."""
    return F.when(whole > 0, amount / whole).otherwise(F.lit(0.0))


def mean_exact(c: Column) -> Column:
    """A mean of degrees that does not depend on the order of rows: of integer nanodegrees."""
    return F.sum(F.round(c * 1e9).cast("decimal(38,0)")).cast("double") / F.count(c) / 1e9
