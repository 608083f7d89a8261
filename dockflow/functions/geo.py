"""Distances between coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.schemas import EARTH_RADIUS_KM, RIDE_SPEED_KMH

# WGS-84 ellipsoid, kilometres.
_MAJOR_KM = 6378.137
_FLATTENING = 1 / 298.257223563


def _col(value) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(float(value))


def get_distance(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km (haversine). Arguments are column names, columns or numbers."""
    la1, lo1, la2, lo2 = (F.radians(_col(v)) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def ride_minutes(km: Column | str, speed_kmh: float = RIDE_SPEED_KMH) -> Column:
    """Minutes by bike for a distance in km."""
    return _col(km) / speed_kmh * 60


def ellipsoid_km(lat1, lon1, lat2, lon2, rounds: int = 12) -> np.ndarray:
    """Inverse geodesic on WGS-84 by Vincenty's iteration, over whole arrays.

    Nearly antipodal pairs, where the iteration does not settle, get the great-circle distance.
    """
    la1, lo1, la2, lo2 = (np.radians(np.asarray(v, dtype="float64")) for v in (lat1, lon1, lat2, lon2))
    f = _FLATTENING
    minor = _MAJOR_KM * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(la1)), np.arctan((1 - f) * np.tan(la2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    dlon = lo2 - lo1
    lam, last = dlon, dlon
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            last = lam
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, cu1 * cu2 * sl / np.where(sin_s == 0, 1.0, sin_s))
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a == 0, 0.0, cos_s - 2 * su1 * su2 / np.where(cos2_a == 0, 1.0, cos2_a))
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            lam = dlon + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        k2 = cos2_a * (_MAJOR_KM**2 - minor**2) / minor**2
        a = 1 + k2 / 16384 * (4096 + k2 * (k2 * (320 - 175 * k2) - 768))
        b = k2 / 1024 * (256 + k2 * (k2 * (74 - 47 * k2) - 128))
        turn = b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)
        shift = b * sin_s * (mid + b / 4 * (cos_s * (2 * mid**2 - 1) - turn))
        km = minor * a * (sigma - shift)
        h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin(dlon / 2) ** 2
        sphere = 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    return np.where(np.abs(lam - last) < 1e-10, km, np.where(np.isnan(la1 + lo1 + la2 + lo2), np.nan, sphere))


@F.pandas_udf(T.DoubleType())
def _geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(ellipsoid_km(lat1, lon1, lat2, lon2))


def geodesic_km(lat1, lon1, lat2, lon2) -> Column:
    """Distance in km on the WGS-84 ellipsoid; Arrow batches, one vectorised call per batch."""
    return _geodesic(*(_col(v).cast("double") for v in (lat1, lon1, lat2, lon2)))
