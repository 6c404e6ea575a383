"""Places on the ellipsoid: transverse Mercator both ways in column functions, and distances along geodesics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid WGS 84, and the scale and false origin of UTM (fixed values).
A, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0
_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Radius of the sphere whose meridian is as long as the ellipsoid's.
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)

#: Series in the third flattening, from its first power on, of each multiple angle: from the sphere to the plane, from the plane
#: to the sphere, and from the conformal latitude to the latitude (fixed values).
_TO_PLANE = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440], [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
]
_TO_SPHERE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800], [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720], [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
]
_TO_LATITUDE = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675], [0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835], [0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175],
]
TO_PLANE, TO_SPHERE, TO_LATITUDE = ([sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in rows] for rows in (_TO_PLANE, _TO_SPHERE, _TO_LATITUDE))


def central_meridian(zone: int) -> float:
    return 6.0 * zone - 183.0


def to_utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Metres east (of a false origin) and north of the equator, of degrees."""
    s, off = F.sin(F.radians(lat)), F.radians(lon - central_meridian(zone))
    conformal = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi, eta = F.atan2(conformal, F.cos(off)), F.asinh(F.sin(off) / F.hypot(conformal, F.cos(off)))
    north = sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(TO_PLANE)), xi)
    east = sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(TO_PLANE)), eta)
    return EAST + SCALE * RADIUS * east, SCALE * RADIUS * north


def from_utm(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Degrees of latitude and longitude."""
    xi, eta = north / (SCALE * RADIUS), (east - EAST) / (SCALE * RADIUS)
    x = sum((-b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(TO_SPHERE)), xi)
    y = sum((-b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(TO_SPHERE)), eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(TO_LATITUDE)), chi)
    return F.degrees(lat), central_meridian(zone) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def utm_sql(lat: str, lon: str, zone: int) -> tuple[str, str]:
    """The same in SQL with the functions that it has."""
    s, off = f"sin(radians({lat}))", f"radians({lon} - {central_meridian(zone)}::DOUBLE)"
    e = repr(ECCENTRICITY) + "::DOUBLE"
    c = f"sinh(atanh({s}) - {e} * atanh({e} * {s}))"
    xi, eta = f"atan2({c}, cos({off}))", f"asinh(sin({off}) / sqrt({c} * {c} + cos({off}) * cos({off})))"
    north = " + ".join([xi, *(f"{a!r}::DOUBLE * sin({2 * j + 2} * {xi}) * cosh({2 * j + 2} * {eta})" for j, a in enumerate(TO_PLANE))])
    east = " + ".join([eta, *(f"{a!r}::DOUBLE * cos({2 * j + 2} * {xi}) * sinh({2 * j + 2} * {eta})" for j, a in enumerate(TO_PLANE))])
    k = repr(SCALE * RADIUS) + "::DOUBLE"
    return f"{EAST} + {k} * ({east})", f"{k} * ({north})"


_AT, _WEIGHT = np.polynomial.legendre.leggauss(20)


def _integral(f, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Integrals from low to high, at most half a turn apart, of a smooth function of angles; in two halves."""
    out = 0.0
    mid = (low + high) / 2
    for a, b in ((low, mid), (mid, high)):
        half = (b - a) / 2
        out = out + half * (f((a + b)[..., None] / 2 + half[..., None] * _AT) * _WEIGHT).sum(-1)
    return out


def _shot(azimuth: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude gained and distance by a geodesic that leaves reduced latitude b1 (at most 0, no nearer to the equator than b2)
    by an azimuth, where it comes to b2 going north."""
    sin0 = np.sin(azimuth) * np.cos(b1)
    cos0 = np.hypot(np.cos(azimuth), np.sin(azimuth) * np.sin(b1))
    north1 = np.cos(azimuth) * np.cos(b1)
    north2 = np.sqrt(np.maximum(north1**2 + (np.cos(b2) ** 2 - np.cos(b1) ** 2), 0))
    s1, s2 = np.arctan2(np.sin(b1), north1), np.arctan2(np.sin(b2), north2)
    w1, w2 = np.arctan2(sin0 * np.sin(b1), north1), np.arctan2(sin0 * np.sin(b2), north2)
    k2 = (FLATTENING * (2 - FLATTENING) / (1 - FLATTENING) ** 2 * cos0**2)[..., None]
    root = lambda s: np.sqrt(1 + k2 * np.sin(s) ** 2)
    along = _integral(root, s1, s2) * A * (1 - FLATTENING)
    lag = _integral(lambda s: (2 - FLATTENING) / (1 + (1 - FLATTENING) * root(s)), s1, s2)
    return np.where(w2 - w1 < -1e-9, w2 - w1 + 2 * np.pi, w2 - w1) - FLATTENING * sin0 * lag, along


def geodesic_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres along the shortest way on the ellipsoid between places in degrees, opposite ones included; null gives nan.

    The two places are turned and mirrored so that the first is south of the equator and no nearer to it than the second.
    The longitude that a geodesic gains then grows with its azimuth from 0 to half a turn, so the azimuth is found between
    these bounds, by secants that bisection holds in check.
    """
    lat1, lon1, lat2, lon2 = (np.atleast_1d(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    known = np.isfinite(lat1 + lon1 + lat2 + lon2)
    out = np.full(known.shape, np.nan)
    far = np.abs(lat2) > np.abs(lat1)
    first, second = np.where(far, lat2, lat1)[known], np.where(far, lat1, lat2)[known]
    second = np.where(first > 0, -second, second)
    first = -np.abs(first)
    turn = np.radians(np.abs((lon2 - lon1 + 180) % 360 - 180))[known]
    reduced = lambda lat: np.arctan((1 - FLATTENING) * np.tan(np.radians(np.clip(lat, -90, 90))))
    b1 = np.minimum(reduced(first), -1e-14)  # the equator is left by a hair, so that azimuths tell ways apart
    b2 = np.clip(reduced(second), b1, -b1)
    low, high = np.zeros(len(b1)), np.full(len(b1), np.pi)
    f_low, f_high = _shot(low, b1, b2)[0] - turn, _shot(high, b1, b2)[0] - turn
    azimuth = np.clip(np.arctan2(np.sin(turn) * np.cos(b2), np.cos(b1) * np.sin(b2) - np.sin(b1) * np.cos(b2) * np.cos(turn)), 0, np.pi)
    todo = np.arange(len(b1))
    for step in range(80):
        value = _shot(azimuth[todo], b1[todo], b2[todo])[0] - turn[todo]
        under = value < 0
        low[todo[under]], f_low[todo[under]] = azimuth[todo[under]], value[under]
        high[todo[~under]], f_high[todo[~under]] = azimuth[todo[~under]], value[~under]
        todo = todo[(np.abs(value) > 1e-15) & (high[todo] - low[todo] > 1e-15)]
        if not len(todo):
            break
        with np.errstate(invalid="ignore", divide="ignore"):
            secant = low[todo] - f_low[todo] * (high[todo] - low[todo]) / (f_high[todo] - f_low[todo])
        middle = (low[todo] + high[todo]) / 2
        azimuth[todo] = np.where((step % 3 < 2) & (secant > low[todo]) & (secant < high[todo]), secant, middle)
    way = _shot(azimuth, b1, b2)[1]
    # Along the equator the way is an arc of a circle, unless a shorter one leads past the poles.
    level = (first == 0) & (second == 0) & (turn <= (1 - FLATTENING) * np.pi)
    out[known] = np.where(level, A * turn, np.abs(way))
    return out
