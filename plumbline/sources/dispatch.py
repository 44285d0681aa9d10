"""Fetch control of several sources; a source that fails is reported and the others go on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.landing import LANDING, land, landable
from ..operators.spatial import clip, edges
from ..schema import empty, normalize, validate

Box = tuple[float, float, float, float]


class Provider(NamedTuple):
    """fetch(spark, box) gives a payload; parse(payload) gives rows in the schema, or them and counts of what was left out."""

    fetch: Callable[[SparkSession, Box], object]
    parse: Callable[[object], DataFrame | tuple[DataFrame, DataFrame]]


PROVIDERS: dict[str, Provider] = {}
DEFAULT_SOURCES = ("3dep", "ngs", "opus")


def register(name: str, fetch: Callable, parse: Callable) -> None:
    PROVIDERS[name] = Provider(fetch, parse)


class Status(NamedTuple):
    n_rows: int
    error: str | None
    n_skipped: int = 0
    skip_reasons: Mapping[str, int] = {}


def aoi(spark: SparkSession, area: Box | DataFrame | str) -> tuple[Box, DataFrame | None]:
    """A box, polygon vertices (poly_id, ring, seq, x, y) or a GeoJSON path as a box and edge rows (none for a box)."""
    if isinstance(area, str):
        area = geojson_vertices(spark, area)
    if isinstance(area, DataFrame):
        b = area.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        return tuple(b), edges(area)
    return tuple(area), None


def geojson_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Polygon vertices of a GeoJSON file; rings are closed by their first vertex."""
    import json

    with open(path) as file:
        document = json.load(file)
    rows = []
    for i, feature in enumerate(document.get("features", [document])):
        shape = feature.get("geometry", feature)
        polygons = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
        for p in polygons:
            for r, ring in enumerate(p):
                points = ring[:-1] if ring[0] == ring[-1] else ring
                rows += [(str(i), r, k, float(v[0]), float(v[1])) for k, v in enumerate(points)]
    return spark.createDataFrame(rows, "poly_id string, ring int, seq int, x double, y double")


def fetch_control(
    spark: SparkSession, area: Box | DataFrame | str, sources: Sequence[str] = DEFAULT_SOURCES, target_crs: str | None = None, target_epoch: float | None = None
) -> tuple[DataFrame, dict[str, Status]]:
    """Control of all sources in one frame, and how each source fared.

    Each source is counted inside its own try, as a lazy plan would raise only in the end, for all.
    """
    if (target_crs, target_epoch) != (None, None):
        raise NotImplementedError("control is landed in one fixed frame; transform it afterwards")
    box, polygon = aoi(spark, area)
    parts, status = [], {}
    for name in sources:
        try:
            if name not in PROVIDERS:
                raise KeyError(f"unknown source {name!r}; known: {sorted(PROVIDERS)}")
            provider = PROVIDERS[name]
            got = provider.parse(provider.fetch(spark, box))
            rows, skipped = got if isinstance(got, tuple) else (got, None)
            rows, lost = landable(rows, LANDING)
            rows = normalize(land(rows, LANDING), source=name)
            reasons = {r["reason"]: r["n"] for r in skipped.collect()} if skipped is not None else {}
            reasons |= {f"no operation from {datum}": n for datum, n in lost.items()}
            # a bare count would prune the columns, and with them their errors
            n = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("all")).first()["n"]
            if n:
                parts.append(rows)
            status[name] = Status(n, None, sum(reasons.values()), reasons)
        except Exception as error:  # one source never takes down the others
            status[name] = Status(0, f"{type(error).__name__}: {error}")
    if not parts:
        return empty(spark), status
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if polygon is not None:
        out = clip(out, polygon)
    return validate(out), status
