"""Writing control with its provenance."""

from __future__ import annotations

import datetime as dt
import json
import platform
from pathlib import Path

import pyarrow.parquet as pq
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = b"provenance"


def versions() -> dict[str, str]:
    return {"python": platform.python_version(), "spark": pyspark.__version__}


def provenance(df: DataFrame, fared: dict | None = None, made_by: str | None = None) -> dict:
    """Environment, frame, rows and rows by transform_id, missing ones included."""
    counts = {r[0] if r[0] is not None else "(missing)": r[1] for r in df.groupBy("transform_id").count().collect()}
    frames = [r[0] for r in df.select("frame_crs").distinct().collect()]
    told = {k: v._asdict() if hasattr(v, "_asdict") else v for k, v in (fared or {}).items()}
    return {
        "environment": versions(), "target_crs": frames[0] if len(frames) == 1 else frames, "n_rows": sum(counts.values()), "transforms": counts,
        "sources": told, "command": made_by, "written": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"),
    }


def export_crs(df: DataFrame, horizontal: str) -> str:
    """A compound frame only if all rows with a height have one known vertical frame."""
    with_height = F.col("height").isNotNull()
    v = df.agg(
        F.count_distinct(F.when(with_height, F.col("vertical_crs"))).alias("n"), F.count_if(with_height & F.col("vertical_crs").isNull()).alias("unknown"),
        F.max(F.when(with_height, F.col("vertical_crs"))).alias("one"),
    ).first()
    return f"{horizontal}+{v['one'].removeprefix('EPSG:')}" if v["n"] == 1 and not v["unknown"] else horizontal


def write(df: DataFrame, path: str, fared: dict | None = None, made_by: str | None = None, single_file: bool = False) -> dict:
    """Parquet or CSV by the path's ending, with a JSON file beside it; other endings raise.

    A Parquet table's provenance is also in ``_provenance`` columns' metadata of its schema, so it travels with each file.
    """
    kind = Path(path).suffix.lower()
    if kind not in (".parquet", ".csv"):
        raise ValueError(f"can't write {kind or 'a path without an ending'}; use .parquet or .csv")
    record = provenance(df, fared, made_by)
    out = df.coalesce(1) if single_file else df
    if kind == ".parquet":
        tagged = out.withColumn("transform_id", F.col("transform_id").alias("transform_id", metadata={"provenance": json.dumps(record)}))
        tagged.write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").option("header", True).csv(path)
    Path(path.removeprefix("file:") + ".json").write_text(json.dumps(record, indent=1))
    return record


def read_provenance(path: str) -> dict | None:
    """The provenance in a Parquet table's schema, or None."""
    files = sorted(Path(path).glob("*.parquet")) if Path(path).is_dir() else [Path(path)]
    meta = (pq.read_schema(files[0]).metadata or {}) if files else {}
    if KEY in meta:
        return json.loads(meta[KEY])
    spark = json.loads(meta.get(b"org.apache.spark.sql.parquet.row.metadata", b"{}"))
    for field in spark.get("fields", []):
        if "provenance" in field.get("metadata", {}):
            return json.loads(field["metadata"]["provenance"])
    return None


def stats_csv(summary: DataFrame, path: str) -> None:
    """The statistics table as one CSV, doubles with four decimals."""
    out = summary.select(*[F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_crs(path: str, definition: str) -> None:
    Path(path).write_text(definition.rstrip() + "\n")
