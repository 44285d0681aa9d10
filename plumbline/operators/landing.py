"""Bringing points into one frame: landing by datum, direct transforms, and control into a product's frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import is_finite
from ..registry import ALIASES, NoTransformPath, frame, horizontal, is_dynamic, operation
from ..functions.text import append_tag
from .stats import before_after

LANDING = "EPSG:6318"


def transform_points(df: DataFrame, source: str, target: str, epoch: float | str | None = None) -> DataFrame:
    """x, y and height in another frame.

    ``epoch`` is a number or a column; an operation that depends on time needs one in every row.
    """
    op, accuracy, timed = operation(source, target)
    at = F.lit(None).cast("double") if epoch is None else F.col(epoch) if isinstance(epoch, str) else F.lit(float(epoch))
    if timed:
        if epoch is None:
            raise ValueError(f"{source} to {target} needs an epoch")
        if isinstance(epoch, str) and (n := df.where(~F.coalesce(is_finite(at), F.lit(False))).count()):
            raise ValueError(f"{n} rows have no epoch")
    tag = append_tag(F.col("transform_id"), f"{source}->{target}")
    if staged := getattr(op, "staged", None):
        out = staged(df.withColumn("__epoch", at))
        out = out.withColumns({"x": F.col("__lon"), "y": F.col("__lat"), "height": F.col("__h"), "frame_crs": F.lit(target), "transform_id": tag})
        return out.select(*df.columns, *(["frame_crs"] if "frame_crs" not in df.columns else []))
    x, y, h = op(F.col("x"), F.col("y"), F.col("height"), at)
    return df.withColumns({"x": x, "y": y, "height": h, "frame_crs": F.lit(target), "transform_id": tag})


def land(df: DataFrame, target: str = LANDING, datums: Sequence[str] | None = None) -> DataFrame:
    """Each row from its own horizontal_crs into one frame; heights stay.

    A missing datum counts as the target (identity).  Datums without a registered operation raise before any row is made,
    as do rows of dynamic frames without a coordinate epoch.  One projection: the datum chooses the columns.
    """
    if datums is None:
        datums = [r[0] for r in df.select("horizontal_crs").distinct().collect() if r[0] is not None]
    x, y, tag = F.when(F.lit(False), F.col("x")), F.when(F.lit(False), F.col("y")), F.when(F.lit(False), F.lit(""))
    timed = []
    for datum in datums:
        op, _, needs_epoch = operation(datum, target)
        if needs_epoch:
            timed.append(datum)
        lo, la, _ = op(F.col("x"), F.col("y"), F.coalesce(F.col("height"), F.lit(0.0)), F.col("coord_epoch"))
        here = F.col("horizontal_crs") == datum
        x, y = x.when(here, lo), y.when(here, la)
        tag = tag.when(here, F.lit("identity" if horizontal(datum) == horizontal(target) else f"{datum}->{target}"))
    if timed:
        lost = df.where(F.col("horizontal_crs").isin(timed) & ~F.coalesce(is_finite(F.col("coord_epoch")), F.lit(False))).count()
        if lost:
            raise ValueError(f"{lost} rows of dynamic frames have no coordinate epoch")
    return df.withColumns({
        "x": x.otherwise(F.col("x")), "y": y.otherwise(F.col("y")), "frame_crs": F.lit(target),
        "transform_id": append_tag(F.col("transform_id"), tag.otherwise("identity")),
    })


def landable(df: DataFrame, target: str = LANDING) -> tuple[DataFrame, dict[str, int]]:
    """Rows whose datum has a registered operation to the target, and how many rows of each other datum there are."""
    counts = {r[0]: r[1] for r in df.where("horizontal_crs is not null").groupBy("horizontal_crs").count().collect()}
    lost = {}
    for datum, n in counts.items():
        try:
            operation(datum, target)
        except NoTransformPath:
            lost[datum] = n
    return (df.where(~F.coalesce(F.col("horizontal_crs").isin(*lost), F.lit(False))) if lost else df), lost


def check_declared(control: DataFrame, source: str) -> None:
    """The frame that rows declare must be the one they are to be transformed from.

    A two-dimensional frame says nothing of heights and need only have the same horizontal part; a three-dimensional or compound one
    must be the same, else heights that are ellipsoidal already would be shifted again.
    """
    for (declared,) in control.select("frame_crs").where("frame_crs is not null").distinct().collect():
        flat = "+" not in declared and not frame(declared).name.endswith("3D") and frame(declared).geographic
        if declared != source and not (flat and _flat_name(declared) == _flat_name(source)):
            raise ValueError(f"rows declare {declared}, not {source}; heights are never reinterpreted")


def _flat_name(crs: str) -> str:
    return frame(crs).name.removesuffix(" 3D").removesuffix(" 2D")


def transform_control(control: DataFrame, source: str, target: str, epoch: float = 2010.0) -> tuple[DataFrame, DataFrame]:
    """Control in a product's 3-D frame, with h_ell and xform_acc_m, and the least, median and greatest shift of height."""
    if "+" not in target and frame(target).geographic and not frame(target).name.endswith("3D") and not is_dynamic(target):
        raise ValueError(f"{target} has no height; name a 3-D or projected target")
    if "frame_crs" in control.columns:
        check_declared(control, source)
    _, accuracy, timed = operation(source, target)
    before = control.withColumn("h_before", F.col("height"))
    moved = transform_points(before, source, target, epoch if timed else None)
    known = F.lit(accuracy if accuracy else None).cast("double")
    moved = moved.withColumns({"h_ell": F.col("height"), "xform_acc_m": known})
    return moved.drop("h_before"), before_after(moved, "h_before", "h_ell")


def geoid_offset(points: DataFrame, cells: DataFrame, grid, key: str = "id", out: str = "geoid_m") -> DataFrame:
    """The offset of a supplied geoid grid at points; a zero, which stands for no data in such grids, is missing."""
    from .raster import linear

    got = linear(points, cells, grid, out)
    return got.withColumn(out, F.when(F.col(out) != 0, F.col(out)))


def in_area(lon: float, lat: float, west: float, south: float, east: float, north: float) -> bool:
    """Whether an area of use holds a place; west > east spans the antimeridian."""
    across = west <= lon <= east if west <= east else lon >= west or lon <= east
    return across and south <= lat <= north


__all__ = ["ALIASES", "LANDING", "NoTransformPath", "geoid_offset", "in_area", "land", "transform_control", "transform_points"]
