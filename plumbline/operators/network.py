"""Station velocities at any place: nearest stations within a radius, combined, with honest quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import is_finite
from .nearest import nearest_k

RADIUS_KM, MIN_STATIONS, MAX_STATIONS, SPREAD_MM = 75.0, 3, 15, 4.0
COMPONENTS = tuple(f"vel_{axis}" for axis in "enu")
METHODS = ["idw", "median"]
LABELS = "sta id station site".split()


def label_column(df: DataFrame) -> str:
    for name in LABELS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {LABELS} is a column")


def quality(n: Column, spread_h: Column, min_stations: int, spread_mm: float) -> Column:
    """low_density, single_station, spread_warning or ok, in this precedence."""
    return (
        F.when((n == 0) | (n < min_stations), "low_density")
        .when(n == 1, "single_station")
        .when(spread_h * 1000 > spread_mm, "spread_warning")
        .otherwise("ok")
    )


def interpolate_velocity(
    points: DataFrame, stations: DataFrame, key: str = "pt", method: str = "median", radius_km: float = RADIUS_KM,
    min_stations: int = MIN_STATIONS, max_stations: int = MAX_STATIONS, spread_mm: float = SPREAD_MM, power: float = 2.0,
) -> DataFrame:
    """One row for each point: velocities, spreads, station count, nearest station and quality.

    Points with too few stations keep their count and nearest station but no velocity.  What a point gets depends on its
    place alone, so it is worked out once for each distinct place and joined back to it; keys may repeat.
    """
    places = points.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    found = _at_places(places, stations, method, radius_km, min_stations, max_stations, spread_mm, power)
    out = _joined(points.select(key, "lon", "lat"), "lon", "lat", found).drop("lon", "lat")
    return out.withColumns({"n_stations": F.coalesce("n_stations", F.lit(0).cast("long")), "quality": F.coalesce("quality", F.lit("low_density"))}).select(key, *FOUND)


FOUND = [*COMPONENTS, "spread_h", "spread_u", "n_stations", "nearest_sta", "nearest_km", "quality"]


def _joined(points: DataFrame, lon: str, lat: str, found: DataFrame) -> DataFrame:
    """``points`` with what was found at their places; each row stays once, also where it has no place."""
    out = points.join(found, points[lon].eqNullSafe(found["p_lon"]) & points[lat].eqNullSafe(found["p_lat"]), "left")
    return out.drop("p_lon", "p_lat")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _median(name: str) -> Column:
    v, n = F.array_sort(name), F.size(name)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def _stddev(name: str) -> Column:
    """Of a sample; missing for fewer than two."""
    n = F.size(name)
    off = F.zip_with(name, F.array_repeat(_sum(F.col(name)) / n, n), lambda x, mean: (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(_sum(off) / (n - 1)))


def _at_places(
    places: DataFrame, stations: DataFrame, method: str = "median", radius_km: float = RADIUS_KM, min_stations: int = MIN_STATIONS,
    max_stations: int = MAX_STATIONS, spread_mm: float = SPREAD_MM, power: float = 2.0,
) -> DataFrame:
    """p_lon, p_lat and FOUND for every distinct finite (lon, lat)."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {METHODS}")
    if lacking := {"lon", "lat", *COMPONENTS} - set(stations.columns):
        raise ValueError(f"stations lack {sorted(lacking)}")
    label = label_column(stations)
    good = stations.select(F.col(label).alias("sta"), "lon", "lat", *COMPONENTS)
    for c in ("lon", "lat", *COMPONENTS):
        good = good.where(is_finite(F.col(c)))
    near = nearest_k(places, good, radius_km, max_stations, "sta")
    n = F.size("near").cast("long")
    values = {c: F.col("near")[c].cast("array<double>") for c in COMPONENTS}
    weights = F.transform("near", lambda s: 1 / F.pow(F.greatest(s["distance_km"], F.lit(1e-3)), F.lit(power)))
    got = near.withColumns({"n_stations": n, "w": weights, **values})
    combine = _median if method == "median" else (lambda c: F.when(n > 0, _sum(F.zip_with("w", c, lambda w, x: w * x)) / _sum(F.col("w"))))
    spread = {c: _stddev(c) for c in COMPONENTS}
    first = F.get("near", F.lit(0))
    out = got.select(
        "p_lon", "p_lat", "n_stations", *[combine(c).alias(c) for c in COMPONENTS],
        F.coalesce(F.hypot(spread["vel_e"], spread["vel_n"]), F.lit(0.0)).alias("spread_h"), F.coalesce(spread["vel_u"], F.lit(0.0)).alias("spread_u"),
        first["sta"].alias("nearest_sta"), first["distance_km"].alias("nearest_km"),
    )
    out = out.withColumn("quality", quality(F.col("n_stations"), F.col("spread_h"), min_stations, spread_mm))
    thin = F.col("quality") == "low_density"
    hidden = {c: F.when(~thin, F.col(c)) for c in (*COMPONENTS, "spread_h", "spread_u")}
    return out.withColumns(hidden).select("p_lon", "p_lat", *FOUND)


def fill_velocities(points: DataFrame, stations: DataFrame, key: str = "id", quality_column: str | None = None, **options) -> DataFrame:
    """``points`` with their velocity columns replaced by interpolated ones at their x and y; missing stays missing, and ``key`` may repeat."""
    places = points.select(F.col("x").cast("double").alias("lon"), F.col("y").cast("double").alias("lat"))
    found = _at_places(places, stations, **options)
    found = found.select("p_lon", "p_lat", *COMPONENTS, *([F.col("quality").alias(quality_column)] if quality_column else []))
    out = _joined(points.drop(*COMPONENTS, *([quality_column] if quality_column else [])), "x", "y", found)
    return out.withColumn(quality_column, F.coalesce(quality_column, F.lit("low_density"))) if quality_column else out


def fill_report(filled: DataFrame, quality_column: str) -> DataFrame:
    """Rows and rows with a velocity by quality."""
    return filled.groupBy(quality_column).agg(F.count("*").alias("n_total"), F.count("vel_e").alias("n_filled"))
