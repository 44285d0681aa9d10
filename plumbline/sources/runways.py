"""Runway ends and displaced thresholds from fixed-width facility records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import arcseconds, azimuth_digits, feet, position_class
from ..functions.time import decyear
from ..schema import normalize
from .common import from_text, lines_of

ACC_H, ACC_V = 0.30, 0.076
#: Where the second end's blocks lie: coordinates and their provenance.
END_SHIFT, SOURCE_SHIFT = 222, 291


def _cut(start: int, end: int, shift: int = 0) -> Column:
    """Characters start to end (from 0), trimmed."""
    return F.trim(F.substring("value", start + shift + 1, end - start))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The facility and runway lines of archives' text members, in Latin-1."""
    return lines_of(spark, path, "ISO-8859-1").where(F.substring("value", 1, 3).isin("APT", "RWY"))


def of_text(spark: SparkSession, text: str) -> DataFrame:
    return from_text(spark, text).where(F.substring("value", 1, 3).isin("APT", "RWY"))


def _end(shift: int, source: int) -> Column:
    lat, lon = arcseconds(_cut(103, 115, shift)), arcseconds(_cut(130, 142, shift))
    return F.struct(
        _cut(65, 68, shift).alias("end"), F.lit(False).alias("displaced"), lat.alias("lat"), lon.alias("lon"), feet(_cut(142, 149, shift)).alias("height"),
        azimuth_digits(_cut(68, 71, shift)).alias("true_az"), _cut(568, 584, source).alias("pos_src"), _cut(584, 594, source).alias("pos_src_date"),
        _cut(594, 610, source).alias("elev_src"), F.lit(None).cast("string").alias("dt_len_ft"), (lat.isNotNull() & lon.isNotNull()).alias("placed"),
    )


def _threshold(shift: int, source: int) -> Column:
    lat, lon = arcseconds(_cut(103, 115, shift)), arcseconds(_cut(130, 142, shift))
    return F.struct(
        _cut(65, 68, shift).alias("end"), F.lit(True).alias("displaced"), arcseconds(_cut(171, 183, shift)).alias("lat"), arcseconds(_cut(198, 210, shift)).alias("lon"),
        feet(_cut(210, 217, shift)).alias("height"), azimuth_digits(_cut(68, 71, shift)).alias("true_az"), _cut(620, 636, source).alias("pos_src"),
        _cut(636, 646, source).alias("pos_src_date"), F.lit(None).cast("string").alias("elev_src"), _cut(217, 221, shift).alias("dt_len_ft"),
        (lat.isNotNull() & lon.isNotNull()).alias("placed"),
    )


def rows(lines: DataFrame) -> DataFrame:
    """Up to four points a runway line, joined to its facility; a runway without a facility raises."""
    facility = lines.where(F.substring("value", 1, 3) == "APT").select(
        _cut(3, 14).alias("site_no"), _cut(14, 27).alias("fac_type"), _cut(27, 31).alias("loc_id"), _cut(133, 183).alias("name")
    )
    runway = lines.where(F.substring("value", 1, 3) == "RWY")
    ends = F.array(*[f(a, b) for a, b in ((0, 0), (END_SHIFT, SOURCE_SHIFT)) for f in (_end, _threshold)])
    points = runway.select(_cut(3, 14).alias("site_no"), _cut(16, 23).alias("rwy"), F.explode(ends).alias("e")).select("site_no", "rwy", "e.*")
    orphan = runway.select(_cut(3, 14).alias("site_no")).join(facility, "site_no", "left_anti").first()
    if orphan is not None:
        raise ValueError(f"a runway of site {orphan['site_no']} has no facility record")
    points = points.where("end <> '' and placed and lat is not null and lon is not null").drop("placed")
    out = points.join(facility, "site_no")
    ident = F.concat(F.coalesce(F.nullif("loc_id", F.lit("")), "site_no"), F.lit("_"), "end", F.when(F.col("displaced"), "_DT").otherwise(""))
    kind = F.when(F.col("displaced"), "displaced_threshold").when(F.startswith(F.upper("rwy"), F.lit("H")), "helipad").otherwise("runway_end")
    return out.withColumns({"id": ident, "point_type": kind}).drop("displaced")


def parse(lines: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points in the schema; accuracy only where the position was surveyed."""
    points = rows(lines)
    if box is not None:
        points = points.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    surveyed = position_class(F.col("pos_src")) == "surveyed"
    when = F.try_to_timestamp(F.col("pos_src_date"), F.lit("MM/dd/yyyy"))
    extras = F.struct("fac_type", "loc_id", "name", "site_no", "rwy", "end", F.col("true_az").cast("string").alias("true_az"), "pos_src", "pos_src_date", "elev_src", "dt_len_ft", position_class(F.col("pos_src")).alias("pos_class"))
    out = points.withColumns({
        "height_datum": F.lit("NAVD88"), "horizontal_crs": F.lit("EPSG:6318"), "vertical_crs": F.lit("EPSG:5703"), "ref_frame": F.lit("NAD83(2011)"),
        "frame_epoch": F.lit(2010.0), "coord_epoch": F.lit(2010.0), "measurement_datetime": when, "measurement_epoch": decyear(when),
        "acc_h": F.when(surveyed, ACC_H), "acc_v": F.when(surveyed, ACC_V), "native_x": F.col("lon"), "native_y": F.col("lat"),
        "native_h": F.col("height"), "native_crs": F.lit("EPSG:6349"), "raw": F.to_json(extras), "x": F.col("lon"), "y": F.col("lat"),
    })
    return normalize(out, source="faa", frame="EPSG:6318")
