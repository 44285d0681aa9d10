"""The k nearest stations of places within a radius, exactly, without pairing places with all that lies in the radius.

Places are worked out by tiles, small where stations are dense, each with the stations that can matter to it, so the cost
follows the numbers of places and stations, not of their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.core import is_finite
from ..functions.geodesy import EARTH_KM, haversine_km
from .sizes import LIMIT_BYTES
from .spatial import KM_PER_DEGREE

#: A tile is the smallest cell around a place with so many times k stations.
TILE = 32
LEVELS = 14
#: Cell counts are broadcast up to so many rows; a row takes about 100 bytes in a hashed relation.
BROADCAST_ROWS = LIMIT_BYTES // 100
#: Distances that a kernel holds at once.
AT_ONCE = 1 << 20


class Cells:
    """Bands as high as the radius, cut into cells at least that wide, and each halved in both directions again and again."""

    def __init__(self, radius_km: float, levels: int) -> None:
        self.step = max(radius_km / KM_PER_DEGREE, 1e-6)
        self.bands, self.levels = math.ceil(180 / self.step), levels

    def columns(self, band: Column) -> Column:
        """Cells around the globe in a band of level 0, as wide as the radius where the band is narrowest."""
        edge = F.greatest(F.abs(band * self.step - 90), F.abs((band + 1) * self.step - 90))
        return F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / self.step), F.lit(1)).cast("long")

    def finest(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """The numbers of a place's cell at the last level."""
        most = 1 << self.levels
        b = F.least(F.greatest(F.floor((lat + 90) / self.step * most), F.lit(0)), F.lit(self.bands * most - 1)).cast("long")
        n = self.columns(F.shiftright(b, self.levels)) * most
        return b, F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1).cast("long")

    def at(self, b: Column, c: Column, level: Column | int) -> tuple[Column, Column]:
        """The cell at a level that holds one of the last level."""
        down = F.pow(F.lit(2.0), F.lit(self.levels) - level).cast("long")
        return F.floor(b / down).cast("long"), F.floor(c / down).cast("long")

    def box(self, level: Column, b: Column) -> tuple[Column, Column, Column]:
        """South and north of a cell, and its width in degrees."""
        parts = F.pow(F.lit(2.0), level)
        south = b * self.step / parts - 90
        return south, F.least(south + self.step / parts, F.lit(90.0)), F.lit(360.0) / (self.columns(F.floor(b / parts).cast("long")) * parts)

    def across(self, level: Column, b: Column) -> Column:
        """No two places in a cell are so many km apart: along a meridian, then along a parallel."""
        south, north, width = self.box(level, b)
        low = F.when((south <= 0) & (north >= 0), F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
        return (north - south + width * F.cos(F.radians(low))) * KM_PER_DEGREE


def _levels(levels: list[int], cells: Cells) -> Column:
    """Structs (level, b, c) of the cells around the last level's cell (b, c)."""
    made = []
    for k in levels:
        b, c = cells.at(F.col("b"), F.col("c"), F.lit(k))
        made.append(F.struct(F.lit(k).alias("level"), b.alias("cell_b"), c.alias("cell_c")))
    return F.explode(F.array(*made)).alias("at")


def _windows(tiles: DataFrame, cells: Cells) -> DataFrame:
    """Tiles by the cells of their level that their reach meets, with the box of that reach: south, north, west, wide."""
    level, parts = F.col("level"), F.pow(F.lit(2.0), F.col("level"))
    south, north, width = cells.box(level, F.col("tile_b"))
    deg = F.col("reach") / KM_PER_DEGREE
    out = tiles.withColumns({"south": south - deg, "north": north + deg, "width": width})
    narrow = F.cos(F.radians(F.least(F.greatest(F.abs("south"), F.abs("north")), F.lit(90.0))))
    ratio = F.sin(F.radians(F.least(deg / 2, F.lit(90.0)))) / F.greatest(narrow, F.lit(1e-12))
    out = out.withColumn("side", F.when(ratio >= 1, F.lit(180.0)).otherwise(2 * F.degrees(F.asin(F.least(ratio, F.lit(1.0))))))
    out = out.withColumns({"west": F.col("tile_c") * F.col("width") - F.col("side"), "wide": F.col("width") + 2 * F.col("side")})
    number = lambda lat: F.least(F.greatest(F.floor((lat + 90) / cells.step * parts), F.lit(0)), cells.bands * parts - 1).cast("long")
    out = out.withColumn("cell_b", F.explode(F.sequence(number(F.col("south")), number(F.col("north")))))
    n = (cells.columns(F.floor(F.col("cell_b") / parts).cast("long")) * parts).cast("long")
    out = out.withColumn("n", n)
    first, last = (F.floor(x / 360 * F.col("n")).cast("long") for x in (F.col("west"), F.col("west") + F.col("wide")))
    whole = (last - first + 1 >= F.col("n")) | (F.col("wide") >= 360)
    around = F.when(whole, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.col("n"))))
    return out.withColumn("cell_c", F.explode(around)).select("level", "tile_b", "tile_c", "south", "north", "west", "wide", "cell_b", "cell_c")


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, p = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(p) * np.cos(a), np.cos(p) * np.sin(a), np.sin(p)], axis=1)


def _slack(chord: np.ndarray | float) -> np.ndarray | float:
    """A little more, for what rounding does; distances are compared in the end by Spark's own."""
    return chord * (1 + 1e-9) + 1e-12


def nearest_rows(x: np.ndarray, v: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of places and stations (unit vectors): how many stations each place keeps and their numbers, the k nearest and ties within a chord."""
    counts, found = np.zeros(len(x), dtype=np.int64), []
    order: list[np.ndarray] = []

    def solve(rows: np.ndarray, near: np.ndarray) -> None:
        own = x[rows]
        center = own.mean(axis=0)
        spread = math.sqrt(((own - center) ** 2).sum(axis=1).max())
        away = np.sqrt(((v[near] - center) ** 2).sum(axis=1))
        # no place's k-th station is farther than the center's and the way to the center
        most = min(limit, np.partition(away, k - 1)[k - 1] + spread) if len(near) > k else limit
        near = near[away <= _slack(most + spread)]
        if len(rows) > 8 and len(near) > 8 * k and spread > 0:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = np.argsort(own[:, axis], kind="stable")
            solve(rows[half[: len(rows) // 2]], near)
            solve(rows[half[len(rows) // 2 :]], near)
            return
        part = max(1, AT_ONCE // max(1, len(near)))
        for lo in range(0, len(rows), part):
            some = rows[lo : lo + part]
            d = np.zeros((len(some), len(near)))
            for axis in range(3):
                d += (x[some, axis, None] - v[None, near, axis]) ** 2
            d = np.sqrt(d)
            reach = np.full(len(some), _slack(limit))
            if len(near) > k:
                reach = np.minimum(reach, _slack(np.partition(d, k - 1, axis=1)[:, k - 1]))
            keep = d <= reach[:, None]
            counts[some] = keep.sum(axis=1)
            order.append(some)
            found.append(near[np.nonzero(keep)[1]])

    if len(x):
        solve(np.arange(len(x)), np.arange(len(v)))
    rows = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    # from the order of work to the order of rows
    starts = np.zeros(len(x), dtype=np.int64)
    starts[rows] = np.cumsum(counts[rows]) - counts[rows]
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return counts, flat[at]


def _kernel(k: int, radius_km: float, order: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by tile, its stations before its places: each place with the stations that may be among its k nearest."""
    limit = 2 * math.sin(min(radius_km / EARTH_KM / 2, math.pi / 2))

    def ready(parts: list[pa.StructArray]) -> tuple[pa.StructArray, np.ndarray]:
        s = pa.concat_arrays(parts)
        lon, lat = (pc.struct_field(s, c).to_numpy(zero_copy_only=False) for c in ("s_lon", "s_lat"))
        rank = pc.rank(pc.struct_field(s, order), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64)
        # of stations at one place the first k are enough
        by = np.lexsort((rank, lat, lon))
        new = np.r_[True, (lon[by][1:] != lon[by][:-1]) | (lat[by][1:] != lat[by][:-1])]
        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        by = by[nth < k]
        return s.take(pa.array(by)), _unit(lon[by], lat[by])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, prepared = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("level", "tile_b", "tile_c", "place")], axis=1)
            cuts = np.r_[0, np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                rows = batch.slice(lo, hi - lo)
                key = tuple(keys[lo, :3])
                if key != tile:
                    tile, parts, prepared = key, [], None
                s = rows.column("s")
                if not keys[lo, 3]:
                    parts.append(s)
                    continue
                lon, lat = rows.column("p_lon"), rows.column("p_lat")
                if parts:
                    if prepared is None:
                        prepared = ready(parts)
                        parts = [prepared[0]]
                    counts, which = nearest_rows(_unit(lon.to_numpy(zero_copy_only=False), lat.to_numpy(zero_copy_only=False)), prepared[1], k, limit)
                    near = prepared[0].take(pa.array(which))
                else:
                    counts, near = np.zeros(hi - lo, dtype=np.int64), s.slice(0, 0)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([lon, lat, pa.ListArray.from_arrays(offsets, near)], ["p_lon", "p_lat", "near"])

    return run


def nearest_k(places: DataFrame, stations: DataFrame, radius_km: float, k: int, order: str = "sta") -> DataFrame:
    """(p_lon, p_lat, near) for every distinct place (lon, lat; finite): its k nearest stations within a radius, nearest first.

    ``near`` holds structs of distance_km and the stations' columns without lon and lat; ties of distance go by ``order``.

    A place's reach is what surely holds k stations: the size of the smallest cell around it with k, the radius at most.  A tile is a cell with
    ``TILE`` x k stations or more, if it can be halved so far, and meets the stations in the reach of its places.
    """
    spark = places.sparkSession
    good = places.select(F.col("lon").cast("double").alias("p_lon"), F.col("lat").cast("double").alias("p_lat"))
    good = good.where(is_finite(F.col("p_lon")) & is_finite(F.col("p_lat")))
    there = stations.where(is_finite(F.col("lon")) & is_finite(F.col("lat")))
    rest = [c for c in stations.columns if c not in ("lon", "lat", order)]
    payload = F.struct(F.col(order), *rest, F.col("lon").cast("double").alias("s_lon"), F.col("lat").cast("double").alias("s_lat"))
    n = there.count()
    cells = Cells(radius_km, min(LEVELS, max(0, math.ceil(math.log(max(n, 1) / k, 4)))))
    b, c = cells.finest(F.col("lon").cast("double"), F.col("lat").cast("double"))
    there = there.select(payload.alias("s"), b.alias("b"), c.alias("c"))
    # cells with k stations and more, by level
    counted = there.select(_levels(list(range(1, cells.levels + 1)), cells)).groupBy("at").count().where(F.col("count") >= k) if cells.levels else None
    dense = {r["level"]: r for r in counted.groupBy("at.level").agg(F.count("*").alias("cells"), F.max("count").alias("most")).collect()} if cells.levels else {}
    b, c = cells.finest(F.col("p_lon"), F.col("p_lat"))
    if dense:
        table = F.broadcast(counted) if sum(r["cells"] for r in dense.values()) <= BROADCAST_ROWS else counted
        around = good.withColumns({"b": b, "c": c}).select("p_lon", "p_lat", _levels(sorted(dense), cells)).join(table, "at", "left")
        level = lambda least: F.coalesce(F.max(F.when(F.col("count") >= least, F.col("at.level"))), F.lit(0))
        placed = around.groupBy("p_lon", "p_lat").agg(level(k).alias("fine"), level(TILE * k).alias("level"))
    else:
        placed = good.distinct().withColumns({"fine": F.lit(0), "level": F.lit(0)})
    tile_b, tile_c = cells.at(F.col("b"), F.col("c"), F.col("level"))
    fine_b, _ = cells.at(F.col("b"), F.col("c"), F.col("fine"))
    reach = F.when(F.col("fine") > 0, F.least(cells.across(F.col("fine"), fine_b), F.lit(float(radius_km)))).otherwise(F.lit(float(radius_km)))
    placed = placed.withColumns({"b": b, "c": c}).withColumns({"tile_b": tile_b, "tile_c": tile_c, "reach": reach * (1 + 1e-9) + 1e-6})
    tiles = placed.groupBy("level", "tile_b", "tile_c").agg(F.max("reach").alias("reach"))
    used = [0] + [k_ for k_, r in sorted(dense.items()) if r["most"] >= TILE * k]
    near = there.select("s", _levels(used, cells)).select("s", "at.*")
    near = near.join(_windows(tiles, cells), ["level", "cell_b", "cell_c"])
    inside = F.pmod(F.col("s.s_lon") + 180 - F.col("west"), F.lit(360.0)) <= F.col("wide")
    near = near.where(F.col("s.s_lat").between(F.col("south"), F.col("north")) & (inside | (F.col("wide") >= 360)))
    none = F.lit(None).cast("double")
    rows = near.select("level", "tile_b", "tile_c", F.lit(0).alias("place"), none.alias("p_lon"), none.alias("p_lat"), "s")
    kind = rows.schema["s"].dataType
    rows = rows.unionByName(placed.select("level", "tile_b", "tile_c", F.lit(1).alias("place"), "p_lon", "p_lat", F.lit(None).cast(kind).alias("s")))
    # few bytes but much work: not to be coalesced by size
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(width, "level", "tile_b", "tile_c").sortWithinPartitions("level", "tile_b", "tile_c", "place")
    found = StructType([StructField("p_lon", DoubleType()), StructField("p_lat", DoubleType()), StructField("near", ArrayType(kind))])
    got = rows.mapInArrow(_kernel(k, radius_km, order), found)
    km = lambda s: haversine_km(F.col("p_lon"), F.col("p_lat"), s["s_lon"], s["s_lat"]).alias("distance_km")
    near = F.transform("near", lambda s: F.struct(km(s), *[s[c].alias(c) for c in (order, *rest)]))
    return got.select("p_lon", "p_lat", F.slice(F.array_sort(F.filter(near, lambda s: s["distance_km"] <= radius_km)), 1, k).alias("near"))
