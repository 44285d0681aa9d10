"""Checkpoint Parquet tables with x and y columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import finite
from ..functions.time import decyear
from ..schema import normalize

_USED = set("x y geometry id datetime point_type z_meter_vdatum_update".split())


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The box reaches the Parquet scan as a filter."""
    table = spark.read.parquet(path)
    return table.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])) if box else table


def parse(table: DataFrame) -> DataFrame:
    """Checkpoints in the schema; other columns go to raw as text."""
    extras = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in table.columns if c not in _USED]
    height = finite(F.col("z_meter_vdatum_update").cast("string").try_cast("double"))
    when = F.try_to_timestamp(F.col("datetime").cast("string"))
    out = table.withColumns({
        "height": height, "height_datum": F.lit("NAVD88"), "horizontal_crs": F.lit("EPSG:6318"), "vertical_crs": F.lit("EPSG:5703"),
        "ref_frame": F.lit("NAD83(2011)"), "frame_epoch": F.lit(2010.0), "coord_epoch": F.lit(2010.0), "measurement_datetime": when,
        "measurement_epoch": decyear(when), "native_x": F.col("x"), "native_y": F.col("y"), "native_h": height, "native_crs": F.lit("EPSG:6349"),
        "raw": F.to_json(F.struct(*extras)) if extras else F.lit("{}"),
    })
    return normalize(out, source="3dep", frame="EPSG:6318")
