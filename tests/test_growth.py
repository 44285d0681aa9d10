"""Neighbours of places: the same as brute force, and no more work than the tables are larger."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geodesy as G
from plumbline.operators import network


def most_rows(df) -> int:
    """The rows of the largest step of a query that ran."""

    def steps(node):
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        found = node.metrics().get("numOutputRows")
        yield found.get().value() if found.isDefined() else 0
        for x in [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]:
            yield from steps(x)

    return max(steps(df._jdf.queryExecution().executedPlan()))


def net(spark, stations, points):
    """Stations and points on the same 2 degrees."""
    k = F.col("id")
    x, y = (k * 7919 % 2003 / 1000.0).alias("lon"), (30 + k * 1047 % 1999 / 1000.0).alias("lat")
    st = spark.range(stations).select(k.alias("sta"), x, y, *[(k % 100 / 1e6).alias(c) for c in network.COMPONENTS])
    k = F.col("id")
    return spark.range(points).select(k.alias("pt"), (k * 5003 % 2011 / 1000.0).alias("lon"), (30 + k * 3001 % 1997 / 1000.0).alias("lat")), st


@pytest.mark.parametrize("method", network.METHODS)
def test_lookup_makes_no_pairs_of_all_in_the_radius(spark, method):
    rows = []
    for times in (1, 4):
        df = network.interpolate_velocity(*net(spark, 600 * times, 500 * times), radius_km=400.0, method=method)
        assert [r["n_stations"] for r in df.collect()] == [15] * 500 * times
        rows.append(most_rows(df))
    assert rows[1] < 8 * rows[0]


def brute(places, stations, radius, k):
    out = {}
    sta, lon, lat = (np.array(c) for c in zip(*stations, strict=True))
    p = np.radians(lat)
    for x, y in places:
        q = math.radians(y)
        s = np.sin((p - q) / 2) ** 2 + math.cos(q) * np.cos(p) * np.sin(np.radians(lon - x) / 2) ** 2
        km = 2 * G.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, s)))
        by = [i for i in np.lexsort((sta, km)) if km[i] <= radius][:k]
        out[x, y] = [sta[i] for i in by], [km[i] for i in by]
    return out


@pytest.mark.parametrize(("tile", "radius"), [(1, 300.0), (4, 2500.0), (32, 12000.0), (1, 21000.0)])
def test_nearest_equal_brute_force(spark, monkeypatch, tile, radius):
    """Even and clustered stations, many at one place, the antimeridian, the poles, borders of cells."""
    from plumbline.operators import nearest

    monkeypatch.setattr(nearest, "TILE", tile)
    rng = random.Random(tile)
    at = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(400)]
    at += [(10 + rng.gauss(0, 0.5), 45 + rng.gauss(0, 0.5)) for _ in range(600)] + [(10 + rng.gauss(0, 0.01), 45 + rng.gauss(0, 0.01)) for _ in range(600)]
    at += [(rng.choice([-180, 180]) + rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(200)]
    at += [(rng.uniform(-180, 180), 90 - abs(rng.gauss(0, 2))) for _ in range(200)] + [(20.0, 20.0)] * 60 + [(21.0 + d, 20.0) for d in (-0.5, 0.5, -0.25, 0.25)]
    stations = [(i, (x + 180) % 360 - 180, y) for i, (x, y) in enumerate(at)]
    places = [(s[1], s[2]) for s in rng.sample(stations, 120)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)]
    places += [(10 + rng.gauss(0, 2), 45 + rng.gauss(0, 2)) for _ in range(60)] + [(-180.0, 0.0), (180.0, 0.0), (0.0, 90.0), (0.0, -90.0), (0.0, 0.0), (20.0, 20.0), (21.0, 20.0)]
    want = brute(places, stations, radius, 7)
    st = spark.createDataFrame(stations, "sta long, lon double, lat double")
    pt = spark.createDataFrame(places + places[:9] + [(None, 1.0), (float("nan"), 2.0)], "lon double, lat double")
    got = nearest.nearest_k(pt, st, radius, 7).collect()
    assert len(got) == len(set(places))
    for r in got:
        sta, km = want[r["p_lon"], r["p_lat"]]
        assert [s["distance_km"] for s in r["near"]] == pytest.approx(km, abs=1e-6), r
        # numpy's and Spark's distances differ in their last digit, so stations as far may change places
        apart = [i for i in range(len(km)) if all(abs(km[i] - km[j]) > 1e-9 or km[i] == km[j] for j in range(len(km)) if j != i) and (i + 1 < len(km) or len(km) < 7)]
        assert [r["near"][i]["sta"] for i in apart] == [sta[i] for i in apart], r


def test_names_break_ties_and_points_without_a_place_stay(spark):
    st = spark.createDataFrame([(n, 1.0, 1.0, 0.1, 0.2, 0.3) for n in ("d", "b", "a", "c")], "sta string, lon double, lat double, vel_e double, vel_n double, vel_u double")
    pt = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 1.0), (3, 50.0, 1.0)], "pt long, lon double, lat double")
    for method in network.METHODS:
        got = network.interpolate_velocity(pt, st, max_stations=2, min_stations=2, method=method).orderBy("pt").collect()
        assert [(r["pt"], r["n_stations"], r["nearest_sta"], r["quality"]) for r in got] == [(1, 2, "a", "ok")] * 2 + [(2, 0, None, "low_density"), (3, 0, None, "low_density")]
        assert got[0]["vel_n"] == pytest.approx(0.2) and got[2]["vel_e"] is None and got[3]["spread_h"] is None


def disc_brute(x, y, cells, grid, metres):
    z = np.array([v for r, c, v in cells if (grid.x0 + (c + 0.5) * grid.dx - x) ** 2 + (grid.y0 + (r + 0.5) * grid.dy - y) ** 2 <= metres * metres and v is not None])
    if not len(z) or not (0 <= (x - grid.x0) / grid.dx < grid.width and 0 <= (y - grid.y0) / grid.dy < grid.height):
        return None, None, 0
    return np.median(z), 1.4826 * np.median(np.abs(z - np.median(z))), len(z)


@pytest.mark.parametrize(("dx", "dy", "metres"), [(1.0, -0.05, 1.2), (0.05, 1.0, 1.2), (1.0, 1.0, 0.3), (0.25, -0.25, 2.0), (0.7, 0.3, 40.0)])
def test_discs_equal_brute_force(spark, monkeypatch, dx, dy, metres):
    """Flat and steep cells, gaps, equal values, a cell that is there twice, cells beyond the grid, places on borders and centres."""
    from plumbline.operators import discs, raster

    monkeypatch.setattr(discs, "LEAST_CELLS", 64)
    monkeypatch.setattr(discs, "AT_ONCE", 256)
    rng = random.Random(5)
    height, width = (120, 12) if abs(dy) < abs(dx) else (12, 120) if abs(dx) < abs(dy) else (40, 40)
    g = raster.Grid(-5.0, 7.0, dx, dy, height, width)
    cells = [(r, c, rng.choice([None, 1.0, -0.0, 0.0, rng.uniform(-1, 1), rng.gauss(0, 1e3)])) for r in range(-2, height + 2) for c in range(-2, width + 2) if rng.random() < 0.9]
    cells += cells[:40]
    xy = [(g.x0 + rng.uniform(-1, width + 1) * dx, g.y0 + rng.uniform(-1, height + 1) * dy) for _ in range(60)]
    xy += [(g.x0 + rng.randrange(width) * dx, g.y0 + rng.randrange(height) * dy) for _ in range(20)] + [(g.x0 + (rng.randrange(width) + 0.5) * dx, g.y0 + (rng.randrange(height) + 0.5) * dy) for _ in range(20)]
    pts = spark.createDataFrame([(i % 7, *p) for i, p in enumerate(xy + xy[:5])] + [(1, None, 1.0), (1, float("nan"), 1.0)], "id int, x double, y double")
    got = raster.sample(pts, spark.createDataFrame(cells, "row int, col int, z double"), g, metres=metres).collect()
    assert len(got) == len(xy) + 7
    for r in got:
        want = disc_brute(r["x"], r["y"], cells, g, metres) if r["x"] is not None else (None, None, 0)
        assert (r["h"], r["h_nmad"], r["h_n"]) == want, r


def test_discs_make_no_row_for_each_cell(spark):
    from plumbline.operators import raster

    rows = []
    for times in (1, 4):
        n = 200 * times
        k = F.col("id")
        cells = spark.range(n * 10).select((k % n).cast("int").alias("row"), F.floor(k / n).cast("int").alias("col"), (k * 7919 % 1009 / 10).alias("z"))
        pts = spark.range(300 * times).select("id", (k * 31 % 9973 / 1000).alias("x"), (k * 37 % 9967 / 1000).alias("y"))
        df = raster.sample(pts, cells, raster.Grid(0.0, 0.0, 1.0, 10 / n, n, 10), metres=2.0)
        df.collect()
        rows.append(most_rows(df))
    assert rows[1] < 8 * rows[0]
