"""Reading lines whole, and rows that break the rules of a format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, line_no, value) of text files, split at line feeds only, in their own encoding."""
    raw = spark.read.format("binaryFile").load(path)
    parts = F.posexplode(F.split(F.decode("content", F.lit(encoding)), "\n"))
    out = raw.select(F.col("path").alias("file"), parts)
    return out.select("file", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("col", "\r$", "").alias("value"))


def from_text(spark: SparkSession, text: str, name: str = "text") -> DataFrame:
    """The same for a text at hand."""
    rows = [(name, i + 1, line.removesuffix("\r")) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, value string")


def must(df: DataFrame, good: Column, what: str) -> DataFrame:
    """Raise on the driver with the first line that breaks a rule."""
    bad = df.where(~F.coalesce(good, F.lit(False))).orderBy("file", "line_no").select("line_no", "value").first()
    if bad is not None:
        raise ValueError(f"{what}: line {bad['line_no']}: {bad['value']!r}")
    return df


def fields(n: int = -1) -> Column:
    """The line split at white space; with n, the last field keeps its own."""
    return F.split(F.trim("value"), r"\s+", n)


def bounded(value: Column, at: int) -> Column:
    """Field ``at`` (from 0) of a split array, null beyond its end."""
    return F.get(value, F.lit(at))
