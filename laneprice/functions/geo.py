"""Spherical geometry as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, EARTH_MI = 6_371_000.0, 3958.7613


def _central(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # null for nulls


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return EARTH_M * _central(lat1, lon1, lat2, lon2)


def metres_of(lat1, lon1, lat2, lon2) -> np.ndarray:
    """haversine_m() of numpy arrays."""
    a, b, c, d = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def miles(lat1, lon1, lat2, lon2) -> Column:
    return EARTH_MI * _central(lat1, lon1, lat2, lon2)


def path_miles(path) -> Column:
    """Miles along a path, array<struct<lat, lon>>, summed leg by leg; null for null."""
    p = F.col(path) if isinstance(path, str) else path
    legs = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: miles(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, m: s + m)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees from 0 to 360."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    y, x = F.sin(d - b) * F.cos(c), F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat, lon, course: Column, distance_mi: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point on a course in degrees."""
    a, d, t = F.radians(lat), distance_mi / EARTH_MI, F.radians(course)
    out = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(out))
    return F.degrees(out), F.degrees(F.radians(lon) + turn)


def turned(degrees: Column) -> Column:
    """A difference of longitudes, from -180 to 180."""
    return F.when(F.abs(degrees) <= 180, degrees).otherwise(F.pmod(degrees + 180, F.lit(360.0)) - 180)


def segment_km(lat, lon, lat1, lon1, lat2, lon2, degree_km: float = 110.574) -> Column:
    """Distance from a point to a segment on the plane that is flat at the point; longitudes go round the globe."""
    k = F.cos(F.radians(lat)) * 111.32
    x1, y1, x2, y2 = turned(F.col(lon1) - F.col(lon)) * k, (F.col(lat1) - F.col(lat)) * degree_km, turned(F.col(lon2) - F.col(lon)) * k, (F.col(lat2) - F.col(lat)) * degree_km
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / size)))
    return F.hypot(x1 + t * dx, y1 + t * dy)
