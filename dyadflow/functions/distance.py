"""Distances as column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Mean radius of the earth in km.
RADIUS = 6371.0088


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def internal_distance_km(area_km2: Column) -> Column:
    return F.when(area_km2 < 0, F.raise_error(F.lit("negative area")).cast("double")).otherwise(0.67 * F.sqrt(area_km2 / math.pi))


#: WGS84: equatorial radius in km and flattening; fixed values.
EQUATOR, FLATTENING = 6378.137, 1 / 298.257223563


def _reduced(lat: np.ndarray) -> np.ndarray:
    return np.arctan((1 - FLATTENING) * np.tan(lat))


def _antipodal_km(lat1: np.ndarray, lat2: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The shortest way between nearly antipodal points (radians; lon: difference in longitude), by the azimuth of departure.

    On the auxiliary sphere the difference in longitude grows with the azimuth, from 0 to half a turn, once the point farther from the
    equator comes first and lies south: halving the azimuth's range finds the way, whatever the start. Longitude and length are integrals along the arc (Gauss-Legendre).
    """
    swap = np.abs(lat1) < np.abs(lat2)
    lat1, lat2 = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    north = lat1 > 0
    u1, u2 = _reduced(np.where(north, -lat1, lat1)), _reduced(np.where(north, -lat2, lat2))
    # a point on the equator counts as a hair's breadth south of it, so that ways over either pole exist
    s1, c1, s2, c2 = np.minimum(np.sin(u1), -1e-20), np.cos(u1), np.sin(u2), np.maximum(np.cos(u2), 1e-300)
    nodes, weights = np.polynomial.legendre.leggauss(48)
    lon, second = np.abs(lon), FLATTENING * (2 - FLATTENING) / (1 - FLATTENING) ** 2

    def way(a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(difference in longitude, length in km) of the way that departs by the azimuth a1."""
        sin0 = np.sin(a1) * c1
        cos2 = np.sqrt(np.maximum(0.0, (np.cos(a1) * c1) ** 2 + (c2**2 - c1**2))) / c2
        from_, to = np.arctan2(s1, np.cos(a1) * c1), np.arctan2(s2, cos2 * c2)
        w1, w2 = np.arctan2(sin0 * np.sin(from_), np.cos(from_)), np.arctan2(sin0 * np.sin(to), np.cos(to))
        half = (to - from_) / 2
        root = np.sqrt(1 + second * (1 - sin0**2)[:, None] * np.sin((to + from_)[:, None] / 2 + half[:, None] * nodes) ** 2)
        turned = FLATTENING * sin0 * half * (((2 - FLATTENING) / (1 + (1 - FLATTENING) * root)) @ weights)
        return w2 - w1 - turned, EQUATOR * (1 - FLATTENING) * half * (root @ weights)

    low, high = np.zeros(len(lon)), np.full(len(lon), np.pi)
    for _ in range(56):
        middle = (low + high) / 2
        short = way(middle)[0] < lon
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return way((low + high) / 2)[1]


def inverse_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, steps: int = 40) -> np.ndarray:
    """Vincenty's inverse solution on the ellipsoid, in degrees; pairs on which it does not settle, nearly antipodal ones, are solved by their azimuth."""
    p1, p2, lon = np.radians(lat1), np.radians(lat2), np.radians((lon2 - lon1 + 180) % 360 - 180)
    u1, u2 = _reduced(p1), _reduced(p2)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, moved = lon.copy(), np.full(len(lon), np.inf)
    with np.errstate(all="ignore"):
        for _ in range(steps):
            sin_sigma = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_sigma = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_sigma, cos_sigma)
            sin_a = np.where(sin_sigma > 0, c1 * c2 * np.sin(lam) / sin_sigma, 0.0)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a > 1e-12, cos_sigma - 2 * s1 * s2 / cos2_a, 0.0)
            c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            new = lon + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_sigma * (mid + c * cos_sigma * (2 * mid**2 - 1)))
            moved, lam = np.abs(new - lam), new
        b = EQUATOR * (1 - FLATTENING)
        u = cos2_a * (EQUATOR**2 - b**2) / b**2
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        turn = big_b * sin_sigma * (mid + big_b / 4 * (cos_sigma * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_sigma**2 - 3) * (4 * mid**2 - 3)))
        km = np.where(sin_sigma > 0, b * big_a * (sigma - turn), 0.0)
    wild = (moved > 1e-10) | (np.abs(lam) > np.pi)
    if wild.any():
        km[wild] = _antipodal_km(p1[wild], p2[wild], lon[wild])
    return km


@F.pandas_udf(DoubleType())
def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Distance on the WGS84 ellipsoid in km; null where a coordinate is."""
    known = lat1.notna() & lon1.notna() & lat2.notna() & lon2.notna()
    out = pd.Series(np.nan, index=lat1.index)
    if known.any():
        out[known] = inverse_km(*[x[known].to_numpy(float) for x in (lat1, lon1, lat2, lon2)])
    return out.where(known, None)


def pair_distances(pairs: DataFrame, points: DataFrame, key: str = "code") -> DataFrame:
    """(orig, dest, dist_geodesic_km, dist_greatcircle_km, is_diagonal) of pairs; both distances of a unit to itself are its internal one.

    points has (key, lat, lon, internal_dist_km), one row for each unit.
    """
    placed = pairs
    for role in ("orig", "dest"):
        placed = placed.join(points.select(F.col(key).alias(role), *[F.col(c).alias(f"{c}_{role}") for c in ("lat", "lon", "internal_dist_km")]), role, "left")
    ends = [F.col(c) for c in ("lat_orig", "lon_orig", "lat_dest", "lon_dest")]
    own = F.col("orig") == F.col("dest")
    return placed.select("orig", "dest", *[F.when(own, F.col("internal_dist_km_orig")).otherwise(km).alias(name) for name, km in (("dist_geodesic_km", geodesic_km(*ends)), ("dist_greatcircle_km", great_circle_km(*ends)))], own.alias("is_diagonal"))


def distance_gap(distances: DataFrame) -> DataFrame:
    """One row: the largest difference between the two distances off the diagonal."""
    return distances.where("not is_diagonal").agg(F.max(F.abs(F.col("dist_greatcircle_km") - F.col("dist_geodesic_km"))).alias("gap_km"))
