"""Command line: fetch control, assess products."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .io import write
from .operators.raster import Grid
from .plans.assess import assess
from .sources.dispatch import DEFAULT_SOURCES, fetch_control


def key_values(items: Sequence[str]) -> dict[str, str]:
    """NAME=PATH arguments; malformed or repeated names raise."""
    out: dict[str, str] = {}
    for item in items:
        name, _, path = item.partition("=")
        if not name or not path:
            raise ValueError(f"{item!r} isn't NAME=PATH")
        if name in out:
            raise ValueError(f"{name} is there twice")
        out[name] = path
    return out


def crs_argument(value: str) -> str:
    """A literal, or the text of a file."""
    if os.path.isfile(value):
        with open(value) as file:
            return file.read().strip()
    return value


def _area(text: str) -> tuple[float, ...] | str:
    parts = text.split(",")
    return tuple(map(float, parts)) if len(parts) == 4 else text


def fetch_main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser("fetch-control")
    p.add_argument("--aoi", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--source", action="append")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    rows, status = fetch_control(spark, _area(a.aoi), a.source or DEFAULT_SOURCES)
    if not any(s.n_rows for s in status.values()):
        print(json.dumps({k: s.error for k, s in status.items()}))
        return 1
    write(rows, a.out, status, "fetch-control")
    return 0


def assess_main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Products are cell tables with a grid in <path>.json."""
    p = argparse.ArgumentParser("assess-dem")
    p.add_argument("--control", required=True)
    p.add_argument("--product", metavar="NAME=PATH", required=True, action="append")
    for name, given in (("target", None), ("source", "EPSG:6318")):
        p.add_argument(f"--{name}-crs", required=given is None, default=given)
    p.add_argument("--out", required=True)
    how = p.add_mutually_exclusive_group()
    how.add_argument("--method", choices=["nearest", "linear"], default="linear")
    how.add_argument("--radius", type=float)
    p.add_argument("--require", action="append", default=[], help="sources that the control should hold")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    control = spark.read.parquet(a.control)
    lacking = set(a.require) - {r[0] for r in control.select("source").distinct().collect()}
    if lacking:
        print(f"warning: no control of {sorted(lacking)}")
    rasters = {}
    for name, path in key_values(a.product).items():
        with open(path.rstrip("/") + ".json") as file:
            rasters[name] = (spark.read.parquet(path), Grid(**json.load(file)))
    assess(control, rasters, crs_argument(a.source_crs), crs_argument(a.target_crs), method=a.method, metres=a.radius, out_dir=a.out)
    return 0
