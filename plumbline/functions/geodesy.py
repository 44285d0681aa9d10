"""Closed-form geodesy as columns; angles in degrees, lengths in metres, times in years."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


class Ellipsoid(NamedTuple):
    a: float
    e2: float


GRS80 = Ellipsoid(6378137.0, 0.0066943800229007876)
WGS84 = Ellipsoid(6378137.0, 0.0066943799901413165)


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    s = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))))


def _sines(lon: Column, lat: Column) -> tuple[Column, Column, Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    return F.sin(lam), F.cos(lam), F.sin(phi), F.cos(phi)


def enu_to_ecef(e: Column, n: Column, u: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    sl, cl, sp, cp = _sines(lon, lat)
    outward = u * cp - n * sp  # away from the axis, in the meridian's plane
    return outward * cl - e * sl, outward * sl + e * cl, u * sp + n * cp


def ecef_to_enu(x: Column, y: Column, z: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    sl, cl, sp, cp = _sines(lon, lat)
    outward = x * cl + y * sl
    return y * cl - x * sl, z * cp - outward * sp, outward * cp + z * sp


def _radii(lat: Column, el: Ellipsoid) -> tuple[Column, Column]:
    """Meridian and prime-vertical radius."""
    sp = F.sin(F.radians(lat))
    w = F.sqrt(1 - el.e2 * sp * sp)
    return el.a * (1 - el.e2) / (w * w * w), el.a / w


def geodetic_to_ecef(lon: Column, lat: Column, h: Column, el: Ellipsoid = GRS80) -> tuple[Column, Column, Column]:
    sl, cl, sp, cp = _sines(lon, lat)
    _, n = _radii(lat, el)
    return (n + h) * cp * cl, (n + h) * cp * sl, (n * (1 - el.e2) + h) * sp


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ecef_to_geodetic(x: Column, y: Column, z: Column, el: Ellipsoid = GRS80) -> tuple[Column, Column, Column]:
    """Longitude, latitude, height by Bowring's formula and one fixed-point round (well below 0.1 mm near the Earth)."""
    b = el.a * math.sqrt(1 - el.e2)
    second = (el.a * el.a - b * b) / (b * b)

    def first(s: Column) -> Column:
        p = F.sqrt(s["x"] * s["x"] + s["y"] * s["y"])
        return let(F.struct(F.atan2(s["z"] * el.a, p * b).alias("beta"), p.alias("p")), lambda q: latitude(s, q))

    def latitude(s: Column, q: Column) -> Column:
        up = s["z"] + second * b * F.pow(F.sin(q["beta"]), F.lit(3))
        out = q["p"] - el.e2 * el.a * F.pow(F.cos(q["beta"]), F.lit(3))
        return let(F.sin(F.atan2(up, out)), lambda sp: final(s, q, F.atan2(s["z"] + el.e2 * el.a / F.sqrt(1 - el.e2 * sp * sp) * sp, q["p"])))

    def final(s: Column, q: Column, phi: Column) -> Column:
        def fields(f: Column) -> Column:
            n = el.a / F.sqrt(1 - el.e2 * F.sin(f) * F.sin(f))
            h = q["p"] * F.cos(f) + s["z"] * F.sin(f) - el.a * el.a / n
            return F.struct(F.degrees(F.atan2(s["y"], s["x"])).alias("lon"), F.degrees(f).alias("lat"), h.alias("h"))

        return let(phi, fields)

    out = let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), first)
    return out["lon"], out["lat"], out["h"]


def ecef_to_geodetic_staged(df: DataFrame, el: Ellipsoid = GRS80) -> DataFrame:
    """__X, __Y, __Z of rows as __lon, __lat and __h by the same formula, in successive projections."""
    b = el.a * math.sqrt(1 - el.e2)
    second = (el.a * el.a - b * b) / (b * b)
    x, y, z, p, beta, s, phi = (F.col(f"__{c}") for c in ("X", "Y", "Z", "p", "beta", "s", "phi"))
    out = df.withColumn("__p", F.sqrt(x * x + y * y)).withColumn("__beta", F.atan2(z * el.a, p * b))
    up, outward = z + second * b * F.pow(F.sin(beta), F.lit(3)), p - el.e2 * el.a * F.pow(F.cos(beta), F.lit(3))
    out = out.withColumn("__s", F.sin(F.atan2(up, outward)))
    out = out.withColumn("__phi", F.atan2(z + el.e2 * el.a / F.sqrt(1 - el.e2 * s * s) * s, p))
    h = p * F.cos(phi) + z * F.sin(phi) - el.a * F.sqrt(1 - el.e2 * F.sin(phi) * F.sin(phi))
    return out.withColumns({"__lon": F.degrees(F.atan2(y, x)), "__lat": F.degrees(phi), "__h": h})


def displaced(lon: Column, lat: Column, h: Column, e: Column, n: Column, u: Column, el: Ellipsoid = GRS80) -> tuple[Column, Column, Column]:
    """A position moved by east, north and up metres."""
    m, v = _radii(lat, el)
    base = F.coalesce(h, F.lit(0.0))
    return lon + F.degrees(e / ((v + base) * F.cos(F.radians(lat)))), lat + F.degrees(n / (m + base)), h + u


def pole_from_rates(wx: float, wy: float, wz: float, unit: str) -> tuple[float, float, float]:
    """Longitude, latitude (degrees) and rate (deg/Myr) of a rotation pole from cartesian rates."""
    if unit not in ("deg/Myr", "mas/yr"):
        raise ValueError(f"unit {unit!r} is none of deg/Myr, mas/yr")
    scale = 1.0 if unit == "deg/Myr" else 1 / 3.6
    x, y, z = wx * scale, wy * scale, wz * scale
    rate = math.sqrt(x * x + y * y + z * z)
    if rate == 0:
        raise ValueError("a pole that doesn't turn has no direction")
    return math.degrees(math.atan2(y, x)), math.degrees(math.asin(z / rate)), rate


def omega(pole_lon: float, pole_lat: float, rate: float) -> tuple[float, float, float]:
    """Cartesian angular velocity in radians a year."""
    w = math.radians(rate) * 1e-6
    lam, phi = math.radians(pole_lon), math.radians(pole_lat)
    return w * math.cos(phi) * math.cos(lam), w * math.cos(phi) * math.sin(lam), w * math.sin(phi)


def rotation_enu(lon: Column, lat: Column, h: Column, w: tuple[Column | float, ...], el: Ellipsoid = GRS80) -> tuple[Column, Column, Column]:
    """East, north, up velocity of a rotation at a position."""
    x, y, z = geodetic_to_ecef(lon, lat, F.coalesce(h, F.lit(0.0)), el)
    wx, wy, wz = (c if isinstance(c, Column) else F.lit(c) for c in w)
    return ecef_to_enu(wy * z - wz * y, wz * x - wx * z, wx * y - wy * x, lon, lat)


def magnitude(e: Column, n: Column) -> Column:
    return F.hypot(e, n)


def azimuth(e: Column, n: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0))


def transverse_mercator(lon: Column, lat: Column, lon0: float, el: Ellipsoid = GRS80, k0: float = 0.9996, fe: float = 5e5, fn: float = 0.0) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the sixth order of n (sub-millimetre in a zone)."""
    f = 1 - math.sqrt(1 - el.e2)
    n = f / (2 - f)
    big = el.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    e = math.sqrt(el.e2)
    s, dl = F.sin(F.radians(lat)), F.radians(wrap_lon(lon - lon0))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) * F.cos(dl)))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return fe + k0 * big * x, fn + k0 * big * y
