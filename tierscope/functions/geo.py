"""Distance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierscope.config import EARTH_RADIUS_KM


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; literal end points are constant-folded."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def nearest_point_km(lat: Column, lon: Column, points) -> Column:
    """Distance to the nearest of a short fixed list of (name, lat, lon) points."""
    dists = [haversine_km(lat, lon, plat, plon) for _, plat, plon in points]
    return dists[0] if len(dists) == 1 else F.least(*dists)


def degree_distance(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Euclidean distance in raw degrees (research variant, not kilometres)."""
    return F.sqrt(F.pow(lat - F.lit(lat0), 2) + F.pow(lon - F.lit(lon0), 2))
