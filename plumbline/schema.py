"""The control-point schema: one fixed, ordered, coerced relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType, TimestampType

_TEXT = {
    "id", "source", "raw", "transform_id", "point_type", "ref_frame", "native_crs", "vertical_crs", "horizontal_crs",
    "height_datum",
}
_ORDER = (
    "source id height height_datum horizontal_crs vertical_crs ref_frame frame_epoch coord_epoch measurement_datetime "
    "measurement_epoch point_type acc_h acc_v vel_e vel_n vel_u epoch_residual_m native_x native_y native_h native_crs raw "
    "transform_id"
).split()


class SchemaError(ValueError):
    """A relation that can't be brought into the schema, or isn't in it."""


REQUIRED = ["source", "id"]


def _kind(name: str) -> StringType | TimestampType | DoubleType:
    return StringType() if name in _TEXT else TimestampType() if name == "measurement_datetime" else DoubleType()


#: The fixed columns; geometry follows as x and y, with the frame they are in.
CONTROL = StructType(
    [StructField(name, _kind(name), name not in REQUIRED) for name in _ORDER]
    + [StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("frame_crs", StringType())]
)


def missing_as_null(column: Column) -> Column:
    """A double with NaN turned into null."""
    return F.when(~F.isnan(column), column)


def normalize(df: DataFrame, source: str | None = None, frame: str | None = None) -> DataFrame:
    """Add, cast and order the columns; other columns are dropped, ``raw`` maps and structs become JSON.

    Casts are ANSI: a value that can't be cast raises when it is read, and a type that can't raises here.
    """
    have = {f.name: f for f in df.schema.fields}
    out = []
    for field in CONTROL.fields:
        name = field.name
        if name == "source" and source is not None:
            column = F.lit(source)
        elif name == "frame_crs" and frame is not None:
            column = F.lit(frame)
        elif name not in have:
            column = F.lit(None)
        else:
            column = df[name]
            if name == "raw" and isinstance(have[name].dataType, StructType | MapType):
                column = F.to_json(column)
        column = column.cast(field.dataType)
        if isinstance(field.dataType, DoubleType):
            column = missing_as_null(column)
        out.append(column.alias(name))
    try:
        return df.select(*out)
    except Exception as error:
        raise SchemaError(f"a column can't be cast: {error}") from error


def validate(df: DataFrame, require_crs: bool = True) -> DataFrame:
    """Raise SchemaError unless ``df`` has every column, a frame, no z and a source and id in every row."""
    lacking = [f.name for f in CONTROL.fields if f.name not in df.columns]
    if lacking:
        raise SchemaError(f"columns are missing: {lacking}")
    if "z" in df.columns:
        raise SchemaError("geometry must be two-dimensional; heights belong in height")
    checks = [F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED]
    checks += [F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("half"), F.count_distinct("frame_crs").alias("frames")]
    checks += [F.count_if(F.col("frame_crs").isNull()).alias("no_frame")]
    found = df.agg(*checks).first()
    bad = [c for c in REQUIRED if found[c]]
    if bad:
        raise SchemaError(f"null in required columns {bad}")
    if found["half"]:
        raise SchemaError("points need both coordinates")
    if require_crs and (found["no_frame"] or found["frames"] > 1):
        raise SchemaError("one frame is needed for all rows")
    return df


def empty(spark: SparkSession) -> DataFrame:
    """No rows in the schema."""
    return spark.createDataFrame([], CONTROL)
