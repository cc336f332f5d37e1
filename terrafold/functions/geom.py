"""Cameras, frames and projections as column expressions.

R is nine columns or values in row order (world to camera), t three; the camera looks along +z.
"""

from __future__ import annotations

from math import radians

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: WGS84.
A, INVERSE_F = 6378137.0, 298.257223563
_F = 1 / INVERSE_F
E2 = _F * (2 - _F)

Vector = tuple[Column, Column, Column]


def rotate(r: list[Column], v: Vector) -> Vector:
    return tuple(r[3 * k] * v[0] + r[3 * k + 1] * v[1] + r[3 * k + 2] * v[2] for k in range(3))


def rotate_back(r: list[Column], v: Vector) -> Vector:
    return tuple(r[k] * v[0] + r[3 + k] * v[1] + r[6 + k] * v[2] for k in range(3))


def camera_centre(r: list[Column], t: Vector) -> Vector:
    x, y, z = rotate_back(r, t)
    return -x, -y, -z


def project(r: list[Column], t: Vector, k: tuple[Column, Column, Column, Column], p: Vector) -> tuple[Column, Column, Column]:
    """(u, v, depth); u and v are null at or behind the camera. k: fx, fy, cx, cy."""
    x, y, z = (a + b for a, b in zip(rotate(r, p), t, strict=True))
    front = z > 1e-12
    return F.when(front, k[0] * x / z + k[2]), F.when(front, k[1] * y / z + k[3]), z


def unproject(r: list[Column], t: Vector, k: tuple, u: Column, v: Column, depth: Column) -> Vector:
    c = ((u - k[2]) / k[0] * depth, (v - k[3]) / k[1] * depth, depth)
    return rotate_back(r, tuple(a - b for a, b in zip(c, t, strict=True)))


def angle_at(a: Vector, b: Vector, p: Vector) -> Column:
    """Degrees between the rays from p to a and to b."""
    u, v = [x - y for x, y in zip(a, p, strict=True)], [x - y for x, y in zip(b, p, strict=True)]
    dot = sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    size = lambda w: F.sqrt(sum((x * x for x in w), F.lit(0.0)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size(u) * size(v))))))


def scale_k(k: tuple, s: float) -> tuple:
    """Intrinsics at another resolution; pixel centres are whole numbers."""
    return k[0] * s, k[1] * s, (k[2] + 0.5) * s - 0.5, (k[3] + 0.5) * s - 0.5


def distort(x: Column, y: Column, k1: float = 0.0, k2: float = 0.0, k3: float = 0.0, p1: float = 0.0, p2: float = 0.0) -> tuple[Column, Column]:
    """Brown's model on normalised coordinates."""
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def distort_fisheye(x: Column, y: Column, k: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Kannala-Brandt; null beyond 75 degrees."""
    r = F.sqrt(x * x + y * y)
    a = F.atan(r)
    a2 = a * a
    bent = a * (1 + a2 * (k[0] + a2 * (k[1] + a2 * (k[2] + a2 * k[3]))))
    factor = F.when(r > 1e-12, bent / r).otherwise(1.0)
    seen = a <= radians(75)
    return F.when(seen, x * factor), F.when(seen, y * factor)


def opk_matrix(omega: Column, phi: Column, kappa: Column) -> list[Column]:
    """Rotation from degrees of omega, phi, kappa, row order."""
    so, co, sp, cp, sk, ck = F.sin(F.radians(omega)), F.cos(F.radians(omega)), F.sin(F.radians(phi)), F.cos(F.radians(phi)), F.sin(F.radians(kappa)), F.cos(F.radians(kappa))
    return [cp * ck, co * sk + so * sp * ck, so * sk - co * sp * ck, -cp * sk, co * ck - so * sp * sk, so * ck + co * sp * sk, sp, -so * cp, co * cp]


def opk_from_matrix(m: list[Column]) -> tuple[Column, Column, Column]:
    return F.degrees(F.atan2(-m[7], m[8])), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[6])))), F.degrees(F.atan2(-m[3], m[0]))


def quaternion(m: list[Column]) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z), w not negative, of a rotation in row order."""
    trace = m[0] + m[4] + m[8]
    w = F.sqrt(F.greatest(F.lit(0.0), 1 + trace)) / 2
    part = lambda a, b, c, d: F.sqrt(F.greatest(F.lit(0.0), 1 + a - b - c)) / 2 * F.when(d < 0, -1.0).otherwise(1.0)
    return w, part(m[0], m[4], m[8], m[7] - m[5]), part(m[4], m[0], m[8], m[2] - m[6]), part(m[8], m[0], m[4], m[3] - m[1])


def rotation_of(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def geodetic_to_ecef(lon: Column, lat: Column, h: Column) -> Vector:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(A) / F.sqrt(1 - E2 * s * s)
    return (n + h) * c * F.cos(F.radians(lon)), (n + h) * c * F.sin(F.radians(lon)), (n * (1 - E2) + h) * s


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> Vector:
    """(lon, lat, h) by Bowring's form, well below a millimetre near the surface."""
    b = A * (1 - _F)
    p = F.sqrt(x * x + y * y)
    a = F.atan2(z * A, p * b)
    second = (A * A - b * b) / (b * b)
    lat = F.atan2(z + second * b * F.pow(F.sin(a), 3), p - E2 * A * F.pow(F.cos(a), 3))
    n = F.lit(A) / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), p * F.cos(lat) + z * F.sin(lat) - n * (1 - E2 * F.pow(F.sin(lat), 2))


def ecef_to_enu(p: Vector, lon: float, lat: float, h: float = 0.0) -> Vector:
    """East, north, up about a fixed place."""
    o = geodetic_to_ecef(F.lit(lon), F.lit(lat), F.lit(h))
    dx, dy, dz = (a - b for a, b in zip(p, o, strict=True))
    sl, cl, sp, cp = F.sin(F.radians(F.lit(lon))), F.cos(F.radians(F.lit(lon))), F.sin(F.radians(F.lit(lat))), F.cos(F.radians(F.lit(lat)))
    return -sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz


def utm_zone(lon: Column, lat: Column) -> Column:
    """The zone's number, with the exceptions of Norway and Svalbard."""
    plain = F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return utm_zone(lon, lat) + F.when(lat >= 0, 32600).otherwise(32700)


def lonlat_to_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional Web Mercator tile."""
    n = float(2**zoom)
    s = F.sin(F.radians(lat))
    return (lon + 180) / 360 * n, (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * n


def tile_to_lonlat(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    return x / n * 360 - 180, F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / n))))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * A


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series of fourth order (micrometres within a zone)."""
    n = _F / (2 - _F)
    big = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    away = F.radians(lon - (zone * 6 - 183))
    root = 2 * n**0.5 / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - root * F.atanh(root * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east * (0.9996 * big) + 500000.0, north * (0.9996 * big) + F.when(lat < 0, 10000000.0).otherwise(0.0)


def azimuthal_equidistant(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = 6371008.8) -> tuple[Column, Column]:
    """On the sphere, about (lon0, lat0)."""
    d = F.radians(lon - lon0)
    s, c, s0, c0 = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(F.lit(lat0))), F.cos(F.radians(F.lit(lat0)))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s0 * s + c0 * c * F.cos(d))))
    k = F.when(angle > 1e-12, angle / F.sin(angle)).otherwise(1.0) * radius
    return k * c * F.sin(d), k * (c0 * s - s0 * c * F.cos(d))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def vincenty(lon1, lat1, lon2, lat2):
    """Ellipsoidal distance in metres as a vectorised function (a pandas UDF): it iterates.

    Where it doesn't converge (nearly antipodal places), the great circle of the mean sphere stands in.
    """
    def solve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        u1, u2 = np.arctan((1 - _F) * np.tan(np.radians(b))), np.arctan((1 - _F) * np.tan(np.radians(d)))
        turn = (c - a) - 360 * np.round((c - a) / 360)
        away = np.radians(turn).to_numpy(float)
        lam, done = away.copy(), np.zeros(len(a), dtype=bool)
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        with np.errstate(invalid="ignore", divide="ignore"):
            for _ in range(200):
                sin_s = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
                cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
                sigma = np.arctan2(sin_s, cos_s)
                sin_a = np.where(sin_s > 0, c1 * c2 * np.sin(lam) / np.where(sin_s > 0, sin_s, 1), 0)
                cos2 = 1 - sin_a**2
                mid = np.where(cos2 > 1e-15, cos_s - 2 * s1 * s2 / np.where(cos2 > 1e-15, cos2, 1), 0)
                k = _F / 16 * cos2 * (4 + _F * (4 - 3 * cos2))
                new = away + (1 - k) * _F * sin_a * (sigma + k * sin_s * (mid + k * cos_s * (2 * mid**2 - 1)))
                new = np.asarray(new, dtype=float)
                done = ~(np.abs(new - lam) >= 1e-12) & (np.abs(new) <= np.pi)
                lam = new
                if done.all():
                    break
            b2 = (A * (1 - _F)) ** 2
            u = cos2 * (A * A - b2) / b2
            ka = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            kb = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            step = kb * sin_s * (mid + kb / 4 * (cos_s * (2 * mid**2 - 1) - kb / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
            h = np.sin(np.radians(d - b) / 2) ** 2 + np.cos(np.radians(b)) * np.cos(np.radians(d)) * np.sin(away / 2) ** 2
            sphere = 2 * (2 * A + A * (1 - _F)) / 3 * np.arcsin(np.minimum(1, np.sqrt(h)))
            return pd.Series(np.where(done, A * (1 - _F) * ka * (sigma - step), sphere))

    return pandas_udf(solve, "double")(lon1, lat1, lon2, lat2)


def grid_to_local(x: Column, y: Column, origin: tuple[float, float], factor: float = 1.0) -> tuple[Column, Column]:
    """Projected coordinates in a local metric frame; factor is the projection's scale there."""
    return (x - origin[0]) / factor, (y - origin[1]) / factor


def local_to_grid(x: Column, y: Column, origin: tuple[float, float], factor: float = 1.0) -> tuple[Column, Column]:
    return x * factor + origin[0], y * factor + origin[1]


def utm_scale(lon: Column, lat: Column, zone: Column) -> Column:
    """The point scale of UTM, to the fourth order of the distance from the central meridian."""
    away = F.radians(lon - (zone * 6 - 183)) * F.cos(F.radians(lat))
    c = E2 / (1 - E2) * F.pow(F.cos(F.radians(lat)), 2)
    t = F.pow(F.tan(F.radians(lat)), 2)
    return 0.9996 * (1 + (1 + c) * away * away / 2 + (5 - 4 * t + 42 * c) * F.pow(away, 4) / 24)
