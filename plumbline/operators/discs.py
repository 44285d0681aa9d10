"""Medians and deviations of the cells in discs around places, without a row for each cell of each disc.

A disc is a few stretches of cells along the lines of the raster.  Order statistics of stretches come from a wavelet
matrix of the tile's cells, so a place costs the logarithm of what its disc holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import LIMIT_BYTES

#: Cells that a tile has with its margin, if the reach allows, and cells that it has at least.
MOST_CELLS, LEAST_CELLS = 1 << 22, 1 << 14
#: Stretches that are looked up at once.
AT_ONCE = 1 << 16


class Ordered:
    """Order statistics of unions of stretches of a sequence (a wavelet matrix over ranks)."""

    def __init__(self, z: np.ndarray) -> None:
        self.values, rank = np.unique(z, return_inverse=True)
        rank = rank.astype(np.int32)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(0, int(len(self.values) - 1).bit_length()) - 1, -1, -1):
            one = (rank >> bit) & 1 == 1
            zeros = np.zeros(len(z) + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            rank = np.concatenate([rank[~one], rank[one]])

    def __call__(self, ends: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest (from 0) of each row's stretches; ``ends`` is (2, rows, stretches), begin and end."""
        nth, rank = nth.astype(np.int32), np.zeros(len(nth), dtype=np.int32)
        for bit, zeros, total in self.levels:
            low = zeros[ends]
            n = (low[1] - low[0]).sum(axis=1, dtype=np.int32)
            up = nth >= n
            nth = np.where(up, nth - n, nth)
            rank |= up.astype(np.int32) << bit
            ends = np.where(up[None, :, None], ends - low + total, low)
        return self.values[rank]


def spreads(ordered: Ordered, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, median deviation from it and count of each row's stretches, none of them empty as a whole."""
    n = (ends[1] - ends[0]).sum(axis=1)
    k = (n - 1) // 2
    a = ordered(ends, k)
    even = n % 2 == 0
    b = a.copy()
    b[even] = ordered(ends[:, even], n[even] // 2)
    median = (a + b) / 2
    # deviations grow leftwards from value k and rightwards from value k + 1; of the k + 1 least, low are to the left
    left = lambda i: np.where(i <= k, median - ordered(ends, np.clip(k - i, 0, n - 1)), np.inf)
    right = lambda j: np.where(k + 1 + j < n, ordered(ends, np.clip(k + 1 + j, 0, n - 1)) - median, np.inf)
    low, high = np.maximum(0, 2 * (k + 1) - n), k + 1
    while (low < high).any():
        i = (low + high) // 2
        enough = (left(i) >= right(k - i)) | (i >= high)
        low, high = np.where(enough, low, i + 1), np.where(enough, i, high)
    j = k + 1 - low
    at = np.maximum(np.where(low > 0, left(np.maximum(low - 1, 0)), -np.inf), np.where(j > 0, right(np.maximum(j - 1, 0)), -np.inf))
    after = np.where(even, np.minimum(left(low), right(j)), at)
    return median, (at + after) / 2, n


class Tile:
    """The cells of a tile and its margin, by lines along the axis on which the disc has more cells."""

    def __init__(self, row: np.ndarray, col: np.ndarray, z: np.ndarray, grid: tuple, metres: float) -> None:
        x0, y0, dx, dy = grid
        self.by_column = abs(dy) <= abs(dx)
        self.metres, (self.o_line, self.d_line), (self.o_pos, self.d_pos) = metres, *(((x0, dx), (y0, dy)) if self.by_column else ((y0, dy), (x0, dx)))
        line, pos = (col, row) if self.by_column else (row, col)
        self.line0, self.line1, self.pos0, self.pos1 = int(line.min()), int(line.max()), int(pos.min()), int(pos.max())
        self.wide = self.pos1 - self.pos0 + 2
        keys = (line.astype(np.int64) - self.line0) * self.wide + (pos - self.pos0)
        by = np.argsort(keys, kind="stable")
        self.keys, self.ordered = keys[by], Ordered(z[by])

    def ends(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(2, rows, stretches): where each place's disc begins and ends among the sorted cells of each line."""
        u, v = (x, y) if self.by_column else (y, x)
        reach, square = math.ceil(self.metres / abs(self.d_line)) + 1, self.metres * self.metres
        line = np.floor((u - self.o_line) / self.d_line).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
        e = self.o_line + (line + 0.5) * self.d_line - u[:, None]
        left = square - e * e
        half = np.sqrt(np.maximum(left, 0)) / abs(self.d_pos)
        center = ((v - self.o_pos) / self.d_pos - 0.5)[:, None]

        def inside(q: np.ndarray) -> np.ndarray:
            f = self.o_pos + (q + 0.5) * self.d_pos - v[:, None]
            return e * e + f * f <= square

        # a guess, moved to where the test on the cell's centre itself turns
        low, high = np.ceil(center - half).astype(np.int64) - 1, np.floor(center + half).astype(np.int64) + 1
        for _ in range(3):
            low, high = low + ~inside(low), high - ~inside(high)
        some = (left >= 0) & (low <= high) & (line >= self.line0) & (line <= self.line1) & (low <= self.pos1) & (high >= self.pos0)
        base = (np.clip(line, self.line0, self.line1) - self.line0) * self.wide
        a = np.searchsorted(self.keys, base + np.clip(low, self.pos0, self.pos1) - self.pos0, "left")
        b = np.searchsorted(self.keys, base + np.clip(high, self.pos0, self.pos1) - self.pos0, "right")
        ends = np.stack([np.where(some, a, 0), np.where(some, b, 0)]).astype(np.int32)
        # lines that no disc here meets are left out
        most = int(some.sum(axis=1).max()) if len(x) else 0
        first = np.minimum(np.argmax(some, axis=1), line.shape[1] - max(most, 1)) if len(x) else np.zeros(0, dtype=np.int64)
        return np.take_along_axis(ends, (first[:, None] + np.arange(max(most, 1)))[None], axis=2)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the places whose disc has cells: which, median, deviation and count."""
        part = max(16, AT_ONCE // (2 * math.ceil(self.metres / abs(self.d_line)) + 3))
        made = []
        for lo in range(0, len(x), part):
            ends = self.ends(x[lo : lo + part], y[lo : lo + part])
            there = np.nonzero((ends[1] - ends[0]).sum(axis=1))[0]
            if len(there):
                made.append((there + lo, *spreads(self.ordered, ends[:, there])))
        return tuple(np.concatenate(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))


def _kernel(grid: tuple, metres: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by tile, its cells before its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells, tile = None, [], None
        for batch in batches:
            tr, tc, place, row, col, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            cuts = np.r_[0, np.nonzero((tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1]) | (place[1:] != place[:-1]))[0] + 1, len(tr)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if (tr[lo], tc[lo]) != key:
                    key, cells, tile = (tr[lo], tc[lo]), [], None
                if not place[lo]:
                    cells.append((row[lo:hi].copy(), col[lo:hi].copy(), a[lo:hi].copy()))
                    continue
                if cells:
                    tile, cells = Tile(*(np.concatenate(c) for c in zip(*cells, strict=True)), grid, metres), []
                if tile is None:
                    continue
                x, y = a[lo:hi], b[lo:hi]
                which, median, off, n = tile(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(x[which]), pa.array(y[which]), pa.array(median), pa.array(off), pa.array(n.astype(np.int64))], ["p_x", "p_y", "median", "off", "n"])

    return run


def disc_spreads(places: DataFrame, cells: DataFrame, grid, metres: float) -> DataFrame:
    """(p_x, p_y, median, off, n) for distinct places (p_x, p_y, p_r, p_c: the cell they are in) whose disc has cells (c_row, c_col, c_z).

    A tile takes the cells within its reach, so its memory is bounded by the disc: ``MOST_CELLS`` or about 5 times the disc's square.
    """
    spark = places.sparkSession
    reach_r, reach_c = math.ceil(metres / abs(grid.dy)) + 1, math.ceil(metres / abs(grid.dx)) + 1
    side = 2.0
    while side > 0.25 and (side + 2) ** 2 * reach_r * reach_c > MOST_CELLS:
        side /= 2
    high, wide = math.ceil(side * reach_r), math.ceil(side * reach_c)
    least = math.isqrt(LEAST_CELLS)
    high, wide = max(high, math.ceil(LEAST_CELLS / max(wide, least))), max(wide, math.ceil(LEAST_CELLS / max(high, least)))
    last_r, last_c = (grid.height - 1) // high, (grid.width - 1) // wide
    number = lambda c, size: F.floor(F.col(c) / size).cast("int")
    asked = places.withColumns({"tile_r": number("p_r", high), "tile_c": number("p_c", wide)})
    near = cells.where(F.col("c_z").isNotNull() & F.col("c_row").between(-reach_r, grid.height - 1 + reach_r) & F.col("c_col").between(-reach_c, grid.width - 1 + reach_c))
    for out, c, size, reach, last in (("tile_r", "c_row", high, reach_r, last_r), ("tile_c", "c_col", wide, reach_c, last_c)):
        first, final = (F.floor((F.col(c) + s * reach) / size).cast("int") for s in (-1, 1))
        near = near.withColumn(out, F.explode(F.sequence(F.greatest(F.least(first, F.lit(last)), F.lit(0)), F.greatest(F.least(final, F.lit(last)), F.lit(0)))))
    tiles = asked.select("tile_r", "tile_c").distinct()
    few = (last_r + 1) * (last_c + 1) * 100 <= LIMIT_BYTES
    near = near.join(F.broadcast(tiles) if few else tiles, ["tile_r", "tile_c"], "left_semi")
    zero, none = F.lit(0), F.lit(0.0)
    rows = near.select("tile_r", "tile_c", F.lit(0).alias("place"), "c_row", "c_col", F.col("c_z").alias("a"), none.alias("b"))
    rows = rows.unionByName(asked.select("tile_r", "tile_c", F.lit(1).alias("place"), zero.alias("c_row"), zero.alias("c_col"), F.col("p_x").alias("a"), F.col("p_y").alias("b")))
    # few bytes but much work: not to be coalesced by size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(parts, "tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "place")
    rows = rows.select("tile_r", "tile_c", "place", "c_row", "c_col", "a", "b")
    return rows.mapInArrow(_kernel((float(grid.x0), float(grid.y0), float(grid.dx), float(grid.dy)), float(metres)), "p_x double, p_y double, median double, off double, n bigint")
