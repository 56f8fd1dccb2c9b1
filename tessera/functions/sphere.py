"""Expressions on the sphere. Angles are degrees, distances km."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``x`` within bounds; NULL stays NULL, unlike with ``greatest`` and ``least`` alone."""
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(clip(z, -1, 1)))


def arc_degrees_to_km(arc: Column) -> Column:
    return F.radians(arc) * EARTH_RADIUS_KM


def chord(degrees: float) -> float:
    """The straight distance on the unit sphere of an angle."""
    import math

    return 2 * math.sin(math.radians(min(degrees, 180.0)) / 2)


def rotated(lon: Column, lat: Column, pole_lon: Column, pole_lat: Column, angle: Column) -> tuple[Column, Column]:
    """Rotation about a pole by an angle (Rodrigues)."""
    x, y, z = xyz(lon, lat)
    kx, ky, kz = xyz(pole_lon, pole_lat)
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    dot = kx * x + ky * y + kz * z
    rx = x * c + (ky * z - kz * y) * s + kx * dot * (1 - c)
    ry = y * c + (kz * x - kx * z) * s + ky * dot * (1 - c)
    rz = z * c + (kx * y - ky * x) * s + kz * dot * (1 - c)
    return lonlat(rx, ry, rz)
