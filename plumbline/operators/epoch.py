"""Coordinate epochs: quality check, plate models and propagation."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import is_finite
from ..functions.geodesy import GRS80, Ellipsoid, displaced, ecef_to_enu, omega, pole_from_rates, rotation_enu
from ..registry import is_dynamic, is_geographic, is_plate_fixed

RESIDUAL_RATE = 0.16

#: Angular velocities of the ITRF2020 plate motion model in degrees a million years.
_PMM = """
SOMA -0.0225 -0.1997 0.2401 | SOAM -0.0725 -0.0784 -0.0437 | PCFC -0.1122 0.2836 -0.5984 | NUBI 0.0250 -0.1625 0.1991
NOAM 0.0126 -0.1849 -0.0272 | NAZC -0.0907 -0.4336 0.4459 | INDI 0.3159 0.0037 0.4010 | EURA -0.0237 -0.1442 0.2091
CARB 0.0576 -0.3949 0.2017 | AUST 0.4132 0.3265 0.3398 | ARAB 0.3135 -0.0406 0.3994 | ANTA -0.0746 -0.0866 0.1882
AMUR -0.0364 -0.1532 0.2325
"""
PLATES = {p[0]: tuple(map(float, p[1:])) for p in (x.split() for x in _PMM.replace("\n", "|").split("|")) if p}
#: Drift of the origin, in millimetres a year.
ORIGIN_BIAS = (0.37, 0.35, 0.74)
_CODES = "AF NUBI AM AMUR AN ANTA AR ARAB AU AUST CA CARB EU EURA IN INDI NA NOAM NZ NAZC PA PCFC SA SOAM SO SOMA".split()
PLATE_CODES = dict(zip(_CODES[::2], _CODES[1::2], strict=True))


class PlateModel(Protocol):
    """A user's model: a name and three columns of metres a year."""

    name: str

    def velocity_enu(self, lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]: ...


class EulerPole:
    """Rotation about a pole, given in degrees and degrees a million years."""

    def __init__(self, name: str, pole_lon: float, pole_lat: float, rate: float, ellipsoid: Ellipsoid = GRS80) -> None:
        self.name, self.omega, self.ellipsoid = name, omega(pole_lon, pole_lat, rate), ellipsoid

    @classmethod
    def from_rates(cls, name: str, wx: float, wy: float, wz: float, unit: str) -> EulerPole:
        return cls(name, *pole_from_rates(wx, wy, wz, unit))

    def velocity_enu(self, lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
        return rotation_enu(lon, lat, h, self.omega, self.ellipsoid)


class PlateMotion:
    """The ITRF2020 model: one plate for all, or the plate of each row in a column of two-letter codes."""

    def __init__(self, plate: str | None = None, code_column: str = "plate", origin_bias: bool = True) -> None:
        if plate is not None and plate not in PLATES:
            raise KeyError(plate)
        self.plate, self.code_column, self.origin_bias = plate, code_column, origin_bias
        self.name = f"ITRF2020-PMM:{plate or 'per-point'}"

    def velocity_enu(self, lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
        def rate(axis: int) -> Column:
            if self.plate:
                return F.lit(math.radians(PLATES[self.plate][axis]) * 1e-6)
            out = F.when(F.lit(False), F.lit(0.0))
            for code, plate in PLATE_CODES.items():
                out = out.when(F.col(self.code_column) == code, F.lit(math.radians(PLATES[plate][axis]) * 1e-6))
            return out

        e, n, u = rotation_enu(lon, lat, h, (rate(0), rate(1), rate(2)))
        if self.origin_bias:
            be, bn, _ = ecef_to_enu(*(F.lit(b / 1000) for b in ORIGIN_BIAS), lon, lat)
            e, n = e + F.when(e.isNotNull(), be), n + F.when(n.isNotNull(), bn)
        return e, n, F.when(e.isNotNull(), F.lit(0.0)) if self.origin_bias else u


def unreduced(tolerance: float = 1e-6) -> Column:
    """Rows whose coordinates aren't at the epoch of their frame; false where either is missing."""
    both = is_finite(F.col("frame_epoch")) & is_finite(F.col("coord_epoch"))
    return F.coalesce(both & (F.abs(F.col("frame_epoch") - F.col("coord_epoch")) > tolerance), F.lit(False))


def check_epochs(df: DataFrame, tolerance: float = 1e-6, on_violation: str = "warn", out: str = "unreduced") -> DataFrame:
    """``df`` with the mask of rows off their frame's epoch; "raise" counts them and raises."""
    if not {"frame_epoch", "coord_epoch"} <= set(df.columns):
        return df.withColumn(out, F.lit(False))
    marked = df.withColumn(out, unreduced(tolerance))
    if on_violation == "raise" and (n := marked.where(out).count()):
        raise ValueError(f"{n} rows aren't reduced to the epoch of their frame")
    return marked


def propagate(
    df: DataFrame, target_epoch: float, frame: str, plate_model: PlateModel | None = None, on_missing_epoch: str = "raise",
    allow_static: bool = False, residual_rate: float = RESIDUAL_RATE, ellipsoid: Ellipsoid = GRS80,
) -> DataFrame:
    """Move points to an epoch: by their own velocity, else the plate's, else not at all with a bound.

    Checks are one aggregate before the lazy result.  Nothing but coordinates, velocities, coord_epoch, epoch_residual_m
    and transform_id changes.
    """
    if not math.isfinite(target_epoch):
        raise ValueError("the target epoch must be finite")
    if on_missing_epoch not in ("raise", "skip"):
        raise ValueError(f"on_missing_epoch is {on_missing_epoch!r}")
    if not is_geographic(frame):
        raise ValueError(f"{frame} isn't a geographic frame")
    own = is_finite(F.col("vel_e")) & is_finite(F.col("vel_n")) & is_finite(F.col("vel_u"))
    dated = is_finite(F.col("coord_epoch"))
    dt = F.when(dated, F.lit(float(target_epoch)) - F.col("coord_epoch"))
    static = is_plate_fixed(frame) and not is_dynamic(frame)
    really = own & dated & (dt != 0) & ((F.col("vel_e") != 0) | (F.col("vel_n") != 0) | (F.col("vel_u") != 0))
    would_plate = (~own & dated & (dt != 0)) if plate_model is not None else F.lit(False)
    undated = (own if plate_model is None else F.lit(True)) & ~dated
    guard = df.agg(F.count_if(really | would_plate).alias("movers"), F.count_if(undated).alias("undated")).first()
    if static and not allow_static and guard["movers"]:
        raise ValueError(f"{guard['movers']} rows would move in the plate-fixed frame {frame}")
    if guard["undated"] and on_missing_epoch == "raise":
        raise ValueError(f"{guard['undated']} rows that could move have no coordinate epoch")
    velocity = [F.col(f"vel_{axis}") for axis in "enu"]
    if plate_model is not None:
        plate = plate_model.velocity_enu(F.col("x"), F.col("y"), F.col("height"))
        need = ~own & ((dated & (dt != 0)) if static else F.lit(True))
        filled = [F.when(own, v).when(need, p) for v, p in zip(velocity, plate, strict=True)]
    else:
        filled = [F.when(own, v) for v in velocity]
    rows = df.withColumns({"__e": filled[0], "__n": filled[1], "__u": filled[2], "__own": own, "__dt": dt})
    has = F.col("__e").isNotNull() & F.col("__n").isNotNull() & F.col("__u").isNotNull()
    moved = has & F.col("__dt").isNotNull()
    lon, lat, h = displaced(F.col("x"), F.col("y"), F.col("height"), *(F.col(c) * F.col("__dt") for c in ("__e", "__n", "__u")), ellipsoid)
    epoch = f"{target_epoch:g}"
    by_plate = f"prop:plate[{plate_model.name}]->{epoch}" if plate_model is not None else ""
    tag = F.when(moved & F.col("__own"), f"prop:per_point->{epoch}").when(moved, by_plate).otherwise("prop:noop")
    out = rows.withColumns(
        {
            "x": F.when(moved, lon).otherwise(F.col("x")),
            "y": F.when(moved, lat).otherwise(F.col("y")),
            "height": F.when(moved, h).otherwise(F.col("height")),
            "vel_e": F.when(moved, F.col("__e")).otherwise(F.col("vel_e")),
            "vel_n": F.when(moved, F.col("__n")).otherwise(F.col("vel_n")),
            "vel_u": F.when(moved, F.col("__u")).otherwise(F.col("vel_u")),
            "epoch_residual_m": F.when(moved, F.lit(0.0)).otherwise(F.abs(F.col("__dt")) * residual_rate),
            "coord_epoch": F.when(moved, F.lit(float(target_epoch))).otherwise(F.col("coord_epoch")),
            "transform_id": F.concat_ws("+", "transform_id", tag),
        }
    )
    return out.drop("__e", "__n", "__u", "__own", "__dt")


def propagation_report(df: DataFrame) -> DataFrame:
    """Counts by the last tag, with the greatest bound and the rows that can't be assessed."""
    model = F.element_at(F.split("transform_id", r"\+"), -1)
    return df.groupBy(model.alias("model")).agg(
        F.count("*").alias("n"), F.max("epoch_residual_m").alias("max_residual_m"), F.count_if(F.col("epoch_residual_m").isNull()).alias("unassessable")
    )


def with_plates(df: DataFrame, plate_edges: DataFrame) -> DataFrame:
    from .spatial import assign_polygon

    return assign_polygon(df, plate_edges, "plate")
