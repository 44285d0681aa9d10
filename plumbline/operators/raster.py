"""Raster sampling at points over cell tables.

A raster is (row, col, z) cells and a Grid that places them.  All joins are equi-joins on cell numbers;
points outside and cells without data stay, as missing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import finite, is_finite
from .discs import disc_spreads
from .sizes import LIMIT_BYTES, plan_bytes, small_or_shuffled
from .stats import NMAD


class Grid(NamedTuple):
    """Origin (a corner of cell 0, 0), signed cell sizes, shape, nodata value and frame."""

    x0: float
    y0: float
    dx: float
    dy: float
    height: int
    width: int
    nodata: float | None = None
    crs: str | None = None


def masked(z: Column, nodata: float | None) -> Column:
    """z with nodata and everything that isn't finite as null."""
    good = finite(z.cast("double"))
    if nodata is None or math.isnan(nodata):
        return good
    return F.when(good != F.lit(float(nodata)), good)


def _place(grid: Grid) -> tuple[Column, Column]:
    """Fractional column and row of a point, cell edges being whole numbers."""
    return (F.col("x") - grid.x0) / grid.dx, (F.col("y") - grid.y0) / grid.dy


def _inside(c: Column, r: Column, grid: Grid) -> Column:
    return (c >= 0) & (c < grid.width) & (r >= 0) & (r < grid.height)


def _cells(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.select(F.col("row").cast("int").alias("c_row"), F.col("col").cast("int").alias("c_col"), masked(F.col("z"), grid.nodata).alias("c_z"))


def check_frames(points_crs: str | None, grid: Grid, check: bool = True) -> None:
    """The horizontal frames must agree and be known; unchecked, a mismatch only warns."""
    from ..registry import horizontal

    if points_crs is not None and grid.crs is not None and horizontal(points_crs) == horizontal(grid.crs):
        return
    text = f"points are in {points_crs}, the raster in {grid.crs}"
    if check:
        raise ValueError(text)
    import warnings

    warnings.warn(text, stacklevel=2)


def nearest(points: DataFrame, cells: DataFrame, grid: Grid, out: str) -> DataFrame:
    """The value of the cell that contains each point."""
    c, r = _place(grid)
    at = points.withColumns({"p_c": F.when(_inside(c, r, grid), F.floor(c).cast("int")), "p_r": F.when(_inside(c, r, grid), F.floor(r).cast("int"))})
    joined = at.join(small_or_shuffled(_cells(cells, grid)), (F.col("p_r") == F.col("c_row")) & (F.col("p_c") == F.col("c_col")), "left")
    return joined.drop("p_c", "p_r", "c_row", "c_col").withColumnRenamed("c_z", out)


def _quads(cells: DataFrame, grid: Grid, needed: DataFrame) -> DataFrame:
    """(q_row, q_col, z00, z01, z10, z11) of every 2 x 2 block of cells that has data in all four.

    Each cell goes to the four blocks it is in; while the places asked for are few, those of no use go before the shuffle.
    """
    base = _cells(cells, grid).where("c_z is not null")
    blocks = base.select(F.explode(F.array(*[
        F.struct((F.col("c_row") - i).alias("q_row"), (F.col("c_col") - j).alias("q_col"), F.lit(f"z{i}{j}").alias("corner"), F.col("c_z").alias("z"))
        for i in (0, 1) for j in (0, 1)
    ])).alias("q")).select("q.*")
    if plan_bytes(needed) <= LIMIT_BYTES:
        blocks = blocks.join(F.broadcast(needed.distinct()), ["q_row", "q_col"], "left_semi")
    pick = lambda corner: F.max(F.when(F.col("corner") == corner, F.col("z"))).alias(corner)
    return blocks.groupBy("q_row", "q_col").agg(*map(pick, ("z00", "z01", "z10", "z11"))).where("z00 is not null and z01 is not null and z10 is not null and z11 is not null")


def linear(points: DataFrame, cells: DataFrame, grid: Grid, out: str) -> DataFrame:
    """Bilinear on cell centres; missing outside their hull or if one of the four is missing.

    One equi-join of each point with its block of four, so ids don't matter and may repeat.
    """
    c, r = _place(grid)
    c, r = c - 0.5, r - 0.5
    ok = (c >= 0) & (c <= grid.width - 1) & (r >= 0) & (r <= grid.height - 1)
    c0 = F.least(F.floor(c), F.lit(max(grid.width - 2, 0))).cast("int")
    r0 = F.least(F.floor(r), F.lit(max(grid.height - 2, 0))).cast("int")
    at = points.withColumns({"p_c": F.when(ok, c0), "p_r": F.when(ok, r0), "p_u": c - c0, "p_v": r - r0})
    quads = _quads(cells, grid, at.where("p_c is not null").select(F.col("p_r").alias("q_row"), F.col("p_c").alias("q_col")))
    joined = at.join(small_or_shuffled(quads), (F.col("p_r") == F.col("q_row")) & (F.col("p_c") == F.col("q_col")), "left")
    u, v = F.col("p_u"), F.col("p_v")
    value = (1 - u) * (1 - v) * F.col("z00") + u * (1 - v) * F.col("z01") + (1 - u) * v * F.col("z10") + u * v * F.col("z11")
    return joined.withColumn(out, value).drop("p_c", "p_r", "p_u", "p_v", "q_row", "q_col", "z00", "z01", "z10", "z11")


def radius(points: DataFrame, cells: DataFrame, grid: Grid, out: str, metres: float) -> DataFrame:
    """Median, NMAD and count of cells whose centres lie within a radius; outside the raster missing and 0.

    Worked out once for each distinct place and joined back to it, so ids don't matter and many points at one place cost as much as one.
    A place costs the logarithm of what its disc holds (see ``discs``).
    """
    if not (math.isfinite(metres) and metres > 0):
        raise ValueError("the radius must be finite and positive")
    c, r = _place(grid)
    places = points.where(_inside(c, r, grid)).select(F.col("x").cast("double").alias("p_x"), F.col("y").cast("double").alias("p_y")).distinct()
    c, r = (F.col("p_x") - grid.x0) / grid.dx, (F.col("p_y") - grid.y0) / grid.dy
    places = places.select("p_x", "p_y", F.floor(r).cast("int").alias("p_r"), F.floor(c).cast("int").alias("p_c"))
    found = disc_spreads(places, _cells(cells, grid), grid, metres)
    stats = found.select("p_x", "p_y", F.col("median").alias(out), (NMAD * F.col("off")).alias(f"{out}_nmad"), F.col("n").alias(f"{out}_n"))
    joined = points.join(stats, (points["x"] == F.col("p_x")) & (points["y"] == F.col("p_y")), "left").drop("p_x", "p_y")
    return joined.withColumn(f"{out}_n", F.coalesce(f"{out}_n", F.lit(0).cast("long")))


def sample(
    points: DataFrame, cells: DataFrame, grid: Grid, key: str = "id", out: str = "h", method: str = "linear",
    metres: float | None = None, diff: str | None = None, points_crs: str | None = None, check_crs: bool = False,
) -> DataFrame:
    """Sample a raster at points; ``diff`` names a column to take from it.  Each row is sampled by its own x and y; ``key`` may repeat."""
    if metres is not None and method != "linear":
        raise ValueError("a radius excludes a method")
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    if diff is not None and diff not in points.columns:
        raise KeyError(diff)
    made = [out] + ([f"{out}_nmad", f"{out}_n"] if metres is not None else []) + ([f"d{out}"] if diff else [])
    clash = [c for c in made if c in points.columns]
    if clash:
        raise ValueError(f"columns {clash} are there; sampled twice?")
    if check_crs:
        check_frames(points_crs, grid)
    if metres is not None:
        got = radius(points, cells, grid, out, metres)
    else:
        got = (linear if method == "linear" else nearest)(points, cells, grid, out)
    return got.withColumn(f"d{out}", F.col(out) - F.col(diff)) if diff else got


def sample_products(
    control: DataFrame, rasters: Mapping[str, tuple[DataFrame, Grid]], key: str = "id", height: str = "h_ell", method: str = "linear", metres: float | None = None
) -> DataFrame:
    """h_<product> and the residual dh_<product>_before (raster minus height) for each product."""
    out = control
    for name, (cells, grid) in rasters.items():
        if f"h_{name}" in out.columns:
            raise ValueError(f"h_{name} is there; sampled twice?")
        out = sample(out, cells, grid, key, f"h_{name}", method, metres)
        out = out.withColumn(f"dh_{name}_before", F.col(f"h_{name}") - F.col(height))
    return out


def tiles(cells: DataFrame, size: int = 4096) -> DataFrame:
    """Cells with their tile numbers, for tables partitioned by tile."""
    return cells.withColumns({"tile_r": F.floor(F.col("row") / size), "tile_c": F.floor(F.col("col") / size)})


def window(cells: DataFrame, grid: Grid, x: float, y: float, half: float) -> DataFrame:
    """Cells of a square around a place; what lies beyond the raster isn't there."""
    c = sorted(((x - half - grid.x0) / grid.dx, (x + half - grid.x0) / grid.dx))
    r = sorted(((y - half - grid.y0) / grid.dy, (y + half - grid.y0) / grid.dy))
    near = F.col("col").between(math.floor(c[0]), math.ceil(c[1]) - 1) & F.col("row").between(math.floor(r[0]), math.ceil(r[1]) - 1)
    return cells.where(near).withColumn("z", masked(F.col("z"), grid.nodata))


def first_valid(fractions: DataFrame, least: float = 0.01) -> DataFrame:
    """Of (source, priority, valid_fraction): the first source with enough valid pixels, else the last."""
    good = F.min_by("source", F.when(F.col("valid_fraction") > least, F.col("priority")))
    return fractions.agg(F.coalesce(F.when(F.max(F.col("valid_fraction") > least), good), F.max_by("source", "priority")).alias("source"))


def gradients(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells with eastward and southward slopes: central differences, one-sided at the edges.

    Neighbours come by equi-join on shifted cell numbers, so no window spans a whole raster row.
    """
    base = _cells(cells, grid).select(F.col("c_row").alias("row"), F.col("c_col").alias("col"), F.col("c_z").alias("z"))
    shifted = base.select(F.explode(F.array(*[
        F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), F.lit(side).alias("side"), F.col("z").alias("z"))
        for i, j, side in ((0, 0, "o"), (0, -1, "e"), (0, 1, "w"), (-1, 0, "s"), (1, 0, "n"))
    ])).alias("q")).select("q.*")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("z"))).alias(f"z{side}")
    there = lambda side: F.max((F.col("side") == side).cast("int")).alias(f"has_{side}")
    sides = shifted.groupBy("row", "col").agg(*[f(s) for s in "oewsn" for f in (pick, there)]).where("has_o = 1")

    def slope(a: str, b: str, step: float) -> Column:
        """From side b to side a."""
        return (
            F.when((F.col(f"has_{a}") == 1) & (F.col(f"has_{b}") == 1), (F.col(f"z{a}") - F.col(f"z{b}")) / (2 * step))
            .when(F.col(f"has_{a}") == 1, (F.col(f"z{a}") - F.col("zo")) / step)
            .when(F.col(f"has_{b}") == 1, (F.col("zo") - F.col(f"z{b}")) / step)
            .otherwise(F.col("zo") * 0)
        )

    return sides.select("row", "col", F.col("zo").alias("z"), slope("e", "w", abs(grid.dx)).alias("g_e"), slope("s", "n", abs(grid.dy)).alias("g_s"))


#: The lamps of a multidirectional hillshade.
LAMPS = (225.0, 270.0, 315.0, 360.0)


def hillshade(cells: DataFrame, grid: Grid, azimuths: Sequence[float] = (315.0,), altitude: float = 45.0) -> DataFrame:
    """(row, col, shade) in [0, 1]; several azimuths are averaged; missing where a neighbour is."""
    g = gradients(cells, grid)
    slope, aspect = F.atan(F.hypot("g_e", "g_s")), F.atan2(F.col("g_s"), -F.col("g_e"))
    zenith = math.radians(90 - altitude)
    shades = []
    for a in azimuths:
        az = math.radians((360 - a + 90) % 360)
        s = math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(az - aspect)
        shades.append(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))
    total = shades[0]
    for s in shades[1:]:
        total = total + s
    shade = F.when(is_finite(F.col("g_e")) & is_finite(F.col("g_s")) & F.col("z").isNotNull(), total / len(shades))
    return g.select("row", "col", shade.alias("shade"))
