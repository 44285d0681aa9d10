"""Frames, operations between them and output datums; what isn't registered raises."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.geodesy import GRS80, WGS84, Ellipsoid, ecef_to_geodetic, ecef_to_geodetic_staged, geodetic_to_ecef, let, transverse_mercator


class Frame(NamedTuple):
    name: str
    ellipsoid: Ellipsoid
    dynamic: bool = False
    geographic: bool = True
    plate_fixed: bool = False


FRAMES: dict[str, Frame] = {
    "EPSG:6318": Frame("NAD83(2011)", GRS80, plate_fixed=True), "EPSG:6319": Frame("NAD83(2011) 3D", GRS80, plate_fixed=True),
    "EPSG:4269": Frame("NAD83(1986)", GRS80, plate_fixed=True), "EPSG:4152": Frame("NAD83(HARN)", GRS80, plate_fixed=True),
    "EPSG:8860": Frame("NAD83(FBN)", GRS80, plate_fixed=True), "EPSG:4759": Frame("NAD83(NSRS2007)", GRS80, plate_fixed=True),
    "EPSG:6783": Frame("NAD83(CORS96)", GRS80, plate_fixed=True), "EPSG:4258": Frame("ETRS89", GRS80, plate_fixed=True),
    "EPSG:4326": Frame("WGS 84", WGS84), "EPSG:4979": Frame("WGS 84 3D", WGS84),
    "EPSG:7912": Frame("ITRF2014", GRS80, dynamic=True), "EPSG:9000": Frame("ITRF2014 2D", GRS80, dynamic=True),
    "EPSG:9989": Frame("ITRF2020", GRS80, dynamic=True), "EPSG:9990": Frame("ITRF2020 2D", GRS80, dynamic=True),
    "EPSG:7911": Frame("ITRF2008", GRS80, dynamic=True),
}
#: Service frames stand for the ITRF solution they follow.
ALIASES = {"IGS08": "EPSG:7911"} | dict(IGS20="EPSG:9989", IGS14="EPSG:7912")


class NoTransformPath(LookupError):
    """No registered operation leads from one frame to the other."""


def horizontal(crs: str) -> str:
    """The horizontal part of a compound code such as EPSG:6318+5703."""
    return crs.split("+")[0]


def frame(crs: str) -> Frame:
    code = ALIASES.get(horizontal(crs), horizontal(crs))
    if code in FRAMES:
        return FRAMES[code]
    if utm_zone(code):
        return Frame(f"UTM {utm_zone(code)}", GRS80, geographic=False, plate_fixed=True)
    raise NoTransformPath(f"{crs} isn't a registered frame")


def is_dynamic(crs: str) -> bool:
    return frame(crs).dynamic


def is_plate_fixed(crs: str) -> bool:
    return frame(crs).plate_fixed


def is_geographic(crs: str) -> bool:
    return frame(crs).geographic


class UtmFamily(NamedTuple):
    datum: str
    base: str
    first: int
    zones: range
    north: bool = True


#: EPSG numbers of UTM zones by realization: first + zone.
UTM = [
    UtmFamily("nad83_2011", "EPSG:6318", 6329, range(1, 20)), UtmFamily("nad83", "EPSG:4269", 26900, range(1, 24)),
    UtmFamily("nad83_harn", "EPSG:4152", 3739, range(10, 20)), UtmFamily("nad83_nsrs2007", "EPSG:4759", 3706, range(1, 20)),
    UtmFamily("wgs84", "EPSG:4326", 32600, range(1, 61)), UtmFamily("wgs84_south", "EPSG:4326", 32700, range(1, 61), False),
]
OUTPUT_DATUMS = {f.datum: f.base for f in UTM}


def _utm(code: str) -> tuple[UtmFamily, int] | None:
    digits = code.removeprefix("EPSG:")
    for family in UTM if digits.isdigit() else ():
        zone = int(digits) - family.first
        if zone in family.zones:
            return family, zone
    return None


def utm_zone(code: str) -> str | None:
    found = _utm(code)
    return f"{found[1]}{'N' if found[0].north else 'S'}" if found else None


def utm_code(datum: str, zone: int, north: bool = True) -> str:
    """The EPSG code of a zone of an output datum; wgs84 has both hemispheres."""
    for f in UTM:
        if f.datum == (datum if north else f"{datum}_south") and zone in f.zones:
            return f"EPSG:{f.first + zone}"
    raise NoTransformPath(f"no UTM zone {zone} for {datum}")


def target_for(datum: str, lon: float, lat: float) -> str:
    """The UTM target of a place in a datum; a realization of Pacific plates is refused."""
    if datum.lower() in ("nad83_pa11", "nad83_ma11"):
        raise NoTransformPath(f"{datum} follows another plate; name its own target")
    if datum not in OUTPUT_DATUMS:
        raise KeyError(datum)
    zone = int(math.floor((lon + 180) / 6)) % 60 + 1
    return utm_code(datum.removesuffix("_south"), zone, lat >= 0 or datum != "wgs84")


Operation = Callable[[Column, Column, Column, Column], tuple[Column, Column, Column]]
_OPERATIONS: dict[tuple[str, str], tuple[Operation, float | None, bool]] = {}


def register(source: str, target: str, operation: Operation, accuracy_m: float | None = None, needs_epoch: bool = False) -> None:
    """Add columns(lon, lat, h, epoch) -> (x, y, h) as the operation from one frame to another."""
    _OPERATIONS[(source, target)] = (operation, accuracy_m, needs_epoch)


def helmert(parameters: tuple[float, ...], rates: tuple[float, ...], reference_epoch: float, source: Ellipsoid = GRS80, target: Ellipsoid = GRS80) -> Operation:
    """Seven parameters and their rates (m, milliarcseconds, parts per billion), position-vector rotation."""
    mas = math.pi / 180 / 3600 / 1000

    def run(lon: Column, lat: Column, h: Column, epoch: Column) -> tuple[Column, Column, Column]:
        dt = epoch - reference_epoch
        t = [F.lit(p) + F.lit(r) * dt for p, r in zip(parameters, rates, strict=True)]
        xyz = F.struct(*[c.alias(k) for c, k in zip(geodetic_to_ecef(lon, lat, F.coalesce(h, F.lit(0.0)), source), "xyz", strict=True)])

        def turned(p: Column) -> Column:
            x, y, z = p["x"], p["y"], p["z"]
            s, rx, ry, rz = 1 + t[6] * 1e-9, t[3] * mas, t[4] * mas, t[5] * mas
            moved = t[0] + s * x - rz * y + ry * z, t[1] + rz * x + s * y - rx * z, t[2] - ry * x + rx * y + s * z
            return F.struct(*[c.alias(k) for c, k in zip(moved, "xyz", strict=True)])

        made = let(xyz, turned)
        out = made["x"], made["y"], made["z"]
        lo, la, up = ecef_to_geodetic(*out, target)
        return lo, la, F.when(h.isNotNull(), up)

    def staged(df: DataFrame) -> DataFrame:
        """The same over x, y, height and __epoch of rows, in successive projections: each value is computed once, in generated code."""
        dt = F.col("__epoch") - reference_epoch
        made = dict(zip("xyz", geodetic_to_ecef(F.col("x"), F.col("y"), F.coalesce(F.col("height"), F.lit(0.0)), source), strict=True))
        t = {f"__t{i}": F.lit(p) + F.lit(r) * dt for i, (p, r) in enumerate(zip(parameters, rates, strict=True))}
        out = df.withColumns({f"__{k}": c for k, c in made.items()} | t)
        x, y, z = (F.col(f"__{k}") for k in "xyz")
        p = [F.col(f"__t{i}") for i in range(7)]
        s, rx, ry, rz = 1 + p[6] * 1e-9, p[3] * mas, p[4] * mas, p[5] * mas
        moved = p[0] + s * x - rz * y + ry * z, p[1] + rz * x + s * y - rx * z, p[2] - ry * x + rx * y + s * z
        out = ecef_to_geodetic_staged(out.withColumns(dict(zip(("__X", "__Y", "__Z"), moved, strict=True))), target)
        return out.withColumn("__h", F.when(F.col("height").isNotNull(), F.col("__h")))

    run.staged = staged
    return run


#: ITRF2014 to NAD83(2011), the published 14 parameters at 2010.0.
ITRF2014_TO_NAD83 = helmert(
    (1.00530, -1.90921, -0.54157, 26.78138, -0.42027, 10.93206, 0.36891),
    (0.00079, -0.00060, -0.00144, 0.06667, -0.75744, -0.05133, -0.07201),
    2010.0,
)
#: From other solutions by way of ITRF2014, with the published parameters between solutions brought to 2010.0; angles this small add up.
_NAD83 = (1.00530, -1.90921, -0.54157, 26.78138, -0.42027, 10.93206, 0.36891), (0.00079, -0.00060, -0.00144, 0.06667, -0.75744, -0.05133, -0.07201)
_TO_2014 = {
    "EPSG:9989": ((-0.0014, -0.0004, 0.0004, 0, 0, 0, -0.42), (0, -0.0001, 0.0002, 0, 0, 0, 0)),
    "EPSG:7911": ((-0.0016, -0.0019, -0.0024, 0, 0, 0, 0.02), (0, 0, 0.0001, 0, 0, 0, -0.03)),
}


def by_2014(code: str) -> Operation:
    return helmert(*(tuple(a + b for a, b in zip(x, y, strict=True)) for x, y in zip(_NAD83, _TO_2014[code], strict=True)), 2010.0)


for _static in ("EPSG:6318", "EPSG:6319"):
    for _dynamic in ("EPSG:7912", "EPSG:9000"):
        register(_dynamic, _static, ITRF2014_TO_NAD83, 0.015, True)
    for _dynamic, _code in (("EPSG:9989", "EPSG:9989"), ("EPSG:9990", "EPSG:9989"), ("EPSG:7911", "EPSG:7911")):
        register(_dynamic, _static, by_2014(_code), 0.02, True)


def datum_label(crs: str) -> str:
    """A note for heights: the vertical member of a compound frame, else the datum with ``ellipsoid``."""
    _, _, vertical = crs.partition("+")
    if vertical:
        return {"5703": "NAVD88 height", "7968": "NGVD29 height"}.get(vertical.removeprefix("EPSG:"), f"EPSG:{vertical.removeprefix('EPSG:')} height")
    try:
        found = _utm(crs)
        return f"{frame(found[0].base if found else crs).name.removesuffix(' 3D').removesuffix(' 2D')} ellipsoid"
    except LookupError:
        return "ellipsoid"


def operation(source: str, target: str) -> tuple[Operation, float | None, bool]:
    """The operation between two frames: identity, a registered one, or a UTM projection of the same datum; else raises."""
    a, b = (ALIASES.get(horizontal(c), horizontal(c)) for c in (source, target))
    if a == b or (frame(a).geographic and frame(b).geographic and frame(a).name.removesuffix(" 3D").removesuffix(" 2D") == frame(b).name.removesuffix(" 3D").removesuffix(" 2D")):
        return (lambda lon, lat, h, epoch: (lon, lat, h)), 0.0, False
    if (a, b) in _OPERATIONS:
        return _OPERATIONS[(a, b)]
    zone = _utm(b)
    if zone:
        family, number = zone
        first, accuracy, needs = operation(a, family.base)
        fn = 0.0 if family.north else 1e7

        def project(lon: Column, lat: Column, h: Column, epoch: Column) -> tuple[Column, Column, Column]:
            lo, la, up = first(lon, lat, h, epoch)
            x, y = transverse_mercator(lo, la, number * 6.0 - 183, frame(family.base).ellipsoid, fn=fn)
            return x, y, up

        return project, accuracy, needs
    known = sorted(f"{x}->{y}" for x, y in _OPERATIONS)
    raise NoTransformPath(f"no operation from {source} to {target}; registered: {known}")
