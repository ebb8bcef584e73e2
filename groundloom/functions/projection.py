"""UTM to and from geographic coordinates on GRS80 (Krueger series), and areas, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS80 ellipsoid and UTM.
A, FLATTENING, K0, FALSE_EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0

N = FLATTENING / (2 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def utm_to_lonlat(x: Column, y: Column, zone: Column) -> Column:
    """struct(lon, lat) in degrees."""
    xi, eta = y / (K0 * RECTIFYING), (x - FALSE_EASTING) / (K0 * RECTIFYING)
    xi2, eta2 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi2 = xi2 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta2 = eta2 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.atan2(F.sinh(eta2), F.cos(xi2))
    return F.struct((central_meridian(zone) + F.degrees(lon)).alias("lon"), F.degrees(lat).alias("lat"))


def lonlat_to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """struct(x, y) in metres."""
    e = math.sqrt(E2)
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) ** 2))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((FALSE_EASTING + K0 * RECTIFYING * x).alias("x"), (K0 * RECTIFYING * y).alias("y"))


def scale_factor(x: Column, y: Column, zone: Column) -> Column:
    """Point scale of the projection, to second order in the distance from the meridian."""
    lat = F.radians(utm_to_lonlat(x, y, zone)["lat"])
    w = 1 - E2 * F.sin(lat) ** 2
    m, n = A * (1 - E2) / F.pow(w, F.lit(1.5)), A / F.sqrt(w)
    d2 = ((x - FALSE_EASTING) / K0) ** 2
    return K0 * (1 + d2 / (2 * m * n) + d2 * d2 / (24 * m * m * n * n))


def geodesic_area_factor(x0: Column, y0: Column, zone: Column, size: float = 10_000.0) -> Column:
    """Ground area of a square cell over its area in the projection: the mean of 1 / k^2 by Simpson's rule."""
    total = F.lit(0.0)
    for i, wi in enumerate((1, 4, 1)):
        for j, wj in enumerate((1, 4, 1)):
            total = total + wi * wj / scale_factor(x0 + i * size / 2, y0 + j * size / 2, zone) ** 2
    return total / 36


def bbox_area_km2(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    """Rough area of a box in degrees."""
    mid = F.radians((lat_min + lat_max) / 2)
    return (lon_max - lon_min) * 111.32 * F.cos(mid) * (lat_max - lat_min) * 111.32
