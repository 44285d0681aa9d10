"""Spatial joins: boxes, radius and k nearest by grid cells, points in polygons by edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import is_finite
from ..functions.geodesy import EARTH_KM, haversine_km, wrap_lon
from .sizes import small_or_shuffled

KM_PER_DEGREE = EARTH_KM * math.pi / 180


def in_box(x: Column, y: Column, box: Sequence[float]) -> Column:
    """Inside (min x, min y, max x, max y), borders included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def overlaps(begin: Column, end: Column, low: Column, high: Column, slack_days: int = 0) -> Column:
    """Whether two time spans meet, with some days of slack on the second."""
    gap = F.make_interval(days=F.lit(slack_days))
    return (begin <= high + gap) & (end >= low - gap)


def radius_pairs(points: DataFrame, stations: DataFrame, radius_km: float, point_key: str = "pt") -> DataFrame:
    """(point_key, station columns, distance_km) of stations within a radius of points (both with lon, lat).

    The globe is cut into latitude bands as high as the radius, and each band into cells at least that wide,
    so a point meets the stations of the 3 x 3 cells around it in an equi-join on the cell.  Points with
    nothing in reach are absent.  For the k nearest see ``nearest.nearest_k``, which makes no such pairs.
    """
    step = max(radius_km / KM_PER_DEGREE, 1e-6)
    bands = math.ceil(180 / step)

    def band(lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / step), F.lit(bands - 1)).cast("int")

    def columns(b: Column) -> Column:
        """Cells around the globe in a band, as wide as the radius where the band is narrowest."""
        edge = F.greatest(F.abs(b * step - 90), F.abs((b + 1) * step - 90))
        narrow = F.cos(F.radians(F.least(edge, F.lit(90.0))))
        return F.greatest(F.floor(F.lit(360.0) * narrow / step), F.lit(1)).cast("int")

    def cell(lon: Column, b: Column) -> Column:
        n = columns(b)
        return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1).cast("int")

    good = points.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    near = good.select(point_key, F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    near = near.withColumn("cell_b", F.explode(F.array(*[band(F.col("p_lat")) + d for d in (-1, 0, 1)])))
    near = near.where(F.col("cell_b").between(0, bands - 1))
    n = columns(F.col("cell_b"))
    # a cell is counted from the point's own place in that band, so the window holds over band borders
    reach = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(cell(F.col("p_lon"), F.col("cell_b")) + d, n)))
    near = near.withColumn("cell_c", F.explode(reach))
    there = stations.where("lon is not null and lat is not null")
    b = band(F.col("lat"))
    there = there.withColumn("cell_b", b).withColumn("cell_c", cell(F.col("lon"), b)).withColumnsRenamed({"lon": "s_lon", "lat": "s_lat"})
    pairs = near.join(small_or_shuffled(there), ["cell_b", "cell_c"])
    pairs = pairs.withColumn("distance_km", haversine_km(F.col("p_lon"), F.col("p_lat"), F.col("s_lon"), F.col("s_lat")))
    return pairs.where(F.col("distance_km") <= radius_km).drop("cell_b", "cell_c", "p_lon", "p_lat", "s_lon", "s_lat")


def nearest_to(df: DataFrame, lon0: float, lat0: float, n: int) -> DataFrame:
    """The n rows nearest to a place, by equirectangular distance."""
    dx = wrap_lon(F.col("lon") - lon0) * math.cos(math.radians(lat0))
    dy = F.col("lat") - lat0
    return df.withColumn("d2", dx * dx + dy * dy).orderBy("d2", "lon", "lat").limit(n).drop("d2")


def edges(polygons: DataFrame) -> DataFrame:
    """Edge rows (poly_id, seq, x1, y1, x2, y2 and the polygon's box) from (poly_id, ring, seq, x, y) vertices."""
    w = Window.partitionBy("poly_id", "ring").orderBy("seq")
    first = F.first(F.struct("x", "y")).over(w)
    following = F.coalesce(F.lead(F.struct("x", "y")).over(w), first)
    out = polygons.select("poly_id", "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), following.alias("p"))
    out = out.select("poly_id", "ring", "seq", "x1", "y1", F.col("p.x").alias("x2"), F.col("p.y").alias("y2"))
    box = polygons.groupBy("poly_id").agg(F.min("x").alias("bx0"), F.min("y").alias("by0"), F.max("x").alias("bx1"), F.max("y").alias("by1"))
    return out.join(box, "poly_id")


#: Cells along the longer side of a polygon's box.
CELLS = 8


def _covered(edge_rows: DataFrame) -> DataFrame:
    """Edges by the cells from which a ray to +x can meet them: (level, cell_x, cell_y) and the edge.

    Each polygon is covered by cells of a power of two, about ``CELLS`` along its longer side, so small and large ones cost alike.
    """
    extent = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"), F.lit(1e-9))
    out = edge_rows.withColumn("level", F.ceil(F.log2(extent / CELLS)).cast("int"))
    step = F.pow(F.lit(2.0), F.col("level"))
    number = lambda c: F.floor(c / step).cast("long")
    out = out.withColumn("cell_y", F.explode(F.sequence(number(F.least("y1", "y2")), number(F.greatest("y1", "y2")))))
    return out.withColumn("cell_x", F.explode(F.sequence(number(F.col("bx0")), number(F.greatest("x1", "x2")))))


def point_in_polygon(points: DataFrame, edge_rows: DataFrame, boundary: bool) -> DataFrame:
    """(p_x, p_y, poly_id) of the distinct finite places of points in polygons by even-odd ray casting; ``boundary`` says whether the border belongs.

    An equi-join on cells: a place meets the edges of its own cell at each level there is, and the polygon's box is tested then.
    """
    x, y = F.col("p_x"), F.col("p_y")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1)
    on_line = (x2 - x1) * (y - y1) == (x - x1) * (y2 - y1)
    on_edge = on_line & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    covered = _covered(edge_rows)
    places = points.where(is_finite(F.col("x")) & is_finite(F.col("y"))).select(F.col("x").cast("double").alias("p_x"), F.col("y").cast("double").alias("p_y")).distinct()
    # as many levels as the polygons' sizes have powers of two
    levels = sorted(r[0] for r in covered.select("level").distinct().collect())
    if not levels:
        return places.where("false").join(edge_rows.select("poly_id").where("false"))
    at = [F.struct(F.lit(k).alias("level"), F.floor(x / 2.0**k).cast("long").alias("cell_x"), F.floor(y / 2.0**k).cast("long").alias("cell_y")) for k in levels]
    near = places.select("p_x", "p_y", F.explode(F.array(*at)).alias("at")).select("p_x", "p_y", "at.*")
    near = near.join(small_or_shuffled(covered), ["level", "cell_x", "cell_y"]).where(x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1")))
    hit = near.groupBy("p_x", "p_y", "poly_id").agg((F.count_if(crosses) % 2 == 1).alias("inside"), F.bool_or(on_edge).alias("border"))
    keep = (F.col("inside") | F.col("border")) if boundary else (F.col("inside") & ~F.col("border"))
    return hit.where(keep).select("p_x", "p_y", "poly_id")


def clip(points: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Rows strictly inside some polygon; rows at one place stay or go together, whatever their ids."""
    inside = point_in_polygon(points, edge_rows, boundary=False).select("p_x", "p_y").distinct()
    return points.join(inside, (points["x"] == F.col("p_x")) & (points["y"] == F.col("p_y")), "left_semi")


def assign_polygon(points: DataFrame, edge_rows: DataFrame, out: str = "plate") -> DataFrame:
    """``points`` with the alphabetically first polygon that holds them, borders included; null for none."""
    wrapped = points.withColumn("__x", wrap_lon(F.col("x")))
    hit = point_in_polygon(wrapped.select(F.col("__x").alias("x"), "y"), edge_rows, boundary=True).groupBy("p_x", "p_y").agg(F.min("poly_id").alias(out))
    return wrapped.join(hit, (F.col("__x") == F.col("p_x")) & (wrapped["y"] == F.col("p_y")), "left").drop("__x", "p_x", "p_y")


def classify_stations(stations: DataFrame, box: Sequence[float], buffer_km: float) -> DataFrame:
    """inside, buffer or outside of a box grown by some kilometres."""
    dy = buffer_km / 111.0
    dx = dy / max(math.cos(math.radians((box[1] + box[3]) / 2)), 1e-6)
    grown = (box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy)
    x, y = F.col("lon"), F.col("lat")
    return stations.withColumn("place", F.when(in_box(x, y, box), "inside").when(in_box(x, y, grown), "buffer").otherwise("outside"))
