import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.functions import geodesy as G
from plumbline.functions import text as X
from plumbline.functions import time as T
from plumbline.operators import epoch as E
from plumbline.operators import landing, network, raster, spatial
from plumbline.operators import stats as A

NAN = float("nan")


def values(spark, xs):
    return spark.createDataFrame([(float(x) if x is not None else None,) for x in xs], "v double")


def test_statistics_of_a_known_vector(spark):
    df = values(spark, [1, 2, 3, 4, 100, NAN, None, float("inf")])
    r = A.resid_stats(df, "v").first()
    assert (r["n"], r["median"], r["mean"]) == (5, 3.0, 22.0) and abs(r["nmad"] - A.NMAD) < 1e-12
    assert r["std"] == pytest.approx(math.sqrt(1522)) and r["rmse"] == pytest.approx(math.sqrt(2006))
    e = A.error_report(df, "v").first()
    assert (e["n"], e["n_used"], e["n_outliers"], e["mean"]) == (5, 4, 1, 2.5)


def test_no_spread_gates_nothing_but_the_mask_rejects_all(spark):
    df = values(spark, [0.01] * 5 + [0.0] * 10)
    e = A.error_report(df, "v").first()
    assert e["n_outliers"] == 0 and e["n_used"] == 15 and e["rmse"] > 0
    assert A.robust_normalize(df, "v").where("inlier").count() == 0


def test_empty_groups_and_single_values(spark):
    e = A.error_report(values(spark, [None]), "v").first()
    assert e["n"] == 0 and e["median"] is None and e["mean"] is None
    one = A.error_report(values(spark, [2.0]), "v").first()
    assert one["n"] == 1 and one["std"] is None
    assert A.snap_limit(values(spark, [None]), "v").first()["limit"] == 0.1


def test_outlier_mask(spark):
    df = values(spark, [30, 0.15, -0.05, 0.05, -0.2, 0.1, None])
    assert {r["v"]: r["inlier"] for r in A.robust_normalize(df, "v").collect()} == {0.1: True, -0.2: True, 0.05: True, -0.05: True, 0.15: True, 30.0: False, None: False}


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "g string, v double")
    assert {r["g"]: r["median"] for r in A.med_nmad(df, "v", ["g"]).collect()} == {"a": 1.0, None: 3.0}


def test_decimal_years(spark):
    df = spark.createDataFrame([("2010-01-01 00:00:00",), ("2010-07-02 12:00:00",), ("2020-07-02 00:00:00",)], "s string").select(T.decyear(F.to_timestamp("s")).alias("y"))
    assert sorted(r["y"] for r in df.collect()) == [2010.0, 2010.5, 2020.5]
    back = df.select((F.abs(T.decyear(T.decyear_inv(F.col("y"))) - F.col("y")) < 1e-8).alias("ok")).collect()
    assert all(r["ok"] for r in back)
    assert {T.decimal_year(f"2010-07-02T{at}") for at in ("12:00:00", "05:00:00-07:00")} == {2010.5}
    with pytest.raises(ValueError):
        T.time_range(2012, 2011)


def test_short_dates_pivot(spark):
    df = spark.createDataFrame([("17NOV10",), ("96JAN05",), ("68DEC31",), ("xx",)], "s string").select("s", F.year(T.short_date(F.col("s"))).alias("y"))
    assert {r["s"]: r["y"] for r in df.collect()} == {"17NOV10": 2017, "96JAN05": 1996, "68DEC31": 2068, "xx": None}


def test_json_semantics(spark):
    df = spark.createDataFrame([('{"a": 2, "b": NaN, "c": " ", "d": 0}',), ("no json",), (None,)], "raw string")
    rows = df.select(*[X.json_text(F.col("raw"), k).alias(k) for k in "abcd"], X.json_truthy(F.col("raw"), "d").alias("t")).collect()
    assert tuple(rows[0]) == ("2", None, None, "0", None) and all(v is None for r in rows[1:] for v in r)


def test_datums(spark):
    want = {"NAD 83(2011)": "EPSG:6318", "NAD_83(HARN)": "EPSG:4152", "NAD 83(1992)": "EPSG:4152", "NAD 83(FBN)": "EPSG:8860", "NAD 83(2035)": None, "ITRF2016": None, "": None, None: None, "NAD83(NSRS2007)": "EPSG:4759", "NAD 83(CORS96)": "EPSG:6783", "NAD 83(1986)": "EPSG:4269"}
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", X.datum_crs(F.col("s")).alias("c"))
    assert {r["s"]: r["c"] for r in df.collect()} == want


def test_a_pole_at_the_pole_moves_east(spark):
    model = E.EulerPole("spin", 0.0, 90.0, 1.0)
    e, n, u = model.velocity_enu(F.lit(30.0), F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n"), u.alias("u")).first()
    assert r["e"] == pytest.approx(6378137 * math.radians(1e-6)) and abs(r["n"]) < 1e-12 and abs(r["u"]) < 1e-12
    assert G.pole_from_rates(3.6, 0, 0, "mas/yr") == pytest.approx((0, 0, 1))
    with pytest.raises(ValueError):
        G.pole_from_rates(0, 0, 0, "deg/Myr")
    with pytest.raises(KeyError):
        E.PlateMotion("XXXX")


def control(spark, rows):
    return spark.createDataFrame(rows, "id string, x double, y double, height double, coord_epoch double, frame_epoch double, vel_e double, vel_n double, vel_u double, transform_id string")


def test_propagation(spark):
    df = control(spark, [("a", -115.0, 36.0, 100.0, 2010.0, None, 0.0, 0.0, 0.03, None), ("b", -115.0, 36.0, 100.0, 2010.0, None, None, None, None, "t"), ("c", -115.0, 36.0, 1.0, None, None, None, None, None, None)])
    got = {r["id"]: r for r in E.propagate(df, 2020.0, "EPSG:9989").collect()}
    assert got["a"]["height"] == pytest.approx(100.3) and got["a"]["epoch_residual_m"] == 0 and got["a"]["transform_id"] == "prop:per_point->2020"
    assert got["b"]["epoch_residual_m"] == pytest.approx(1.6) and got["b"]["transform_id"] == "t+prop:noop" and got["b"]["coord_epoch"] == 2010.0
    assert got["c"]["epoch_residual_m"] is None
    with pytest.raises(ValueError):
        E.propagate(df, 2020.0, "EPSG:6318")
    with pytest.raises(ValueError):
        E.propagate(df, NAN, "EPSG:9989")
    with pytest.raises(ValueError):
        E.propagate(df, 2020.0, "EPSG:9989", E.PlateMotion("NOAM"))
    assert E.propagate(df.where("id <> 'a'"), 2020.0, "EPSG:6318").count() == 2
    there = E.propagate(df.where("id = 'a'"), 2020.0, "EPSG:9989")
    assert E.propagate(there, 2010.0, "EPSG:9989").first()["height"] == pytest.approx(100.0)
    with pytest.raises(ValueError):
        E.check_epochs(df.withColumn("frame_epoch", F.lit(2000.0)), on_violation="raise")


def _reference_lookup(points, stations, radius, k, least):
    def km(a, b, c, d):
        p, q = math.radians(b), math.radians(d)
        s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * G.EARTH_KM * math.asin(math.sqrt(min(1, s)))

    out = {}
    for pt, lon, lat in points:
        near = sorted((km(lon, lat, s[1], s[2]), s[0], s[3]) for s in stations if lon is not None)
        near = [n for n in near if n[0] <= radius][:k]
        out[pt] = (len(near), statistics.median(n[2] for n in near) if len(near) >= least else None)
    return out


def test_velocity_lookup_equals_a_loop_even_at_the_antimeridian_and_poles(spark):
    rng = random.Random(7)
    stations = [(f"s{i:03d}", rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)]), rng.choice([rng.uniform(-90, 90), rng.uniform(86, 90)]), rng.uniform(-1, 1)) for i in range(300)]
    stations += [("t" + s[0], *s[1:]) for s in stations[:20]]  # ties
    points = [(i, rng.choice([rng.uniform(-180, 180), 179.99, -180.0]), rng.choice([rng.uniform(-90, 90), 89.0])) for i in range(80)] + [(99, None, 1.0)]
    want = _reference_lookup(points, stations, 900.0, 5, 2)
    st = spark.createDataFrame([(*s, s[3], s[3]) for s in stations], "sta string, lon double, lat double, vel_e double, vel_n double, vel_u double")
    got = network.interpolate_velocity(spark.createDataFrame(points, "pt long, lon double, lat double"), st, radius_km=900.0, max_stations=5, min_stations=2).collect()
    assert len(got) == 81
    for r in got:
        n, v = want[r["pt"]]
        assert r["n_stations"] == n and (r["vel_e"] == pytest.approx(v) if v is not None else r["vel_e"] is None)
        assert (r["quality"] == "low_density") == (n < 2)
    with pytest.raises(ValueError):
        network.interpolate_velocity(st, st, method="mean")


GRID = raster.Grid(50.0, 40.0, 1.0, -1.0, 8, 12)


def plane(spark, nodata=()):
    return spark.createDataFrame([(r, c, -9999.0 if (r, c) in nodata else 2 * (50.5 + c) + 3 * (39.5 - r)) for r in range(8) for c in range(12)], "row int, col int, z double")


def points(spark, xy):
    return spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(xy)], "id string, x double, y double")


def test_bilinear_is_exact_on_a_plane(spark):
    xy = [(53.2, 36.7), (50.5, 39.5), (61.5, 32.5), (50.2, 36.0), (70, 36)]
    got = {r["id"]: r["h"] for r in raster.sample(points(spark, xy), plane(spark), GRID).collect()}
    assert [got[str(i)] for i in range(3)] == [pytest.approx(2 * x + 3 * y) for x, y in xy[:3]] and got["3"] is None and got["4"] is None
    gap = raster.sample(points(spark, xy), plane(spark, {(3, 3)}), GRID._replace(nodata=-9999.0)).where("id = '0'").first()
    assert gap["h"] is None


def test_nearest_and_radius(spark):
    got = {r["id"]: r["h"] for r in raster.sample(points(spark, [(53.2, 36.7), (49.9, 36.0)]), plane(spark), GRID, method="nearest").collect()}
    assert got == {"0": 2 * 53.5 + 3 * 36.5, "1": None}
    z = [(r, c, 2.0 * r + c) for r in range(3) for c in range(3)]
    cells = spark.createDataFrame(z, "row int, col int, z double")
    g = raster.Grid(0.0, 3.0, 1.0, -1.0, 3, 3)
    r = {x["id"]: x for x in raster.sample(points(spark, [(1.5, 1.5), (0.0, 2.99), (9, 9)]), cells, g, metres=1.0).collect()}
    assert r["0"]["h_n"] == 5 and r["0"]["h"] == 3.0 and r["0"]["h_nmad"] == pytest.approx(1.4826)
    assert r["1"]["h_n"] == 1 and r["2"]["h_n"] == 0 and r["2"]["h"] is None
    for bad in ({"metres": -1.0}, {"metres": 1.0, "method": "nearest"}, {"method": "cubic"}):
        with pytest.raises(ValueError):
            raster.sample(points(spark, [(1, 1)]), cells, g, **bad)
    with pytest.raises(ValueError):
        raster.sample(points(spark, [(1, 1)]).withColumn("h", F.lit(1)), cells, g)
    with pytest.raises(ValueError):
        raster.check_frames("EPSG:6318", g)


def test_hillshade_of_flat_ground(spark):
    flat = spark.createDataFrame([(r, c, 5.0) for r in range(4) for c in range(4)], "row int, col int, z double")
    for azimuths in ((315.0,), (360.0, 315.0, 270.0, 225.0)):
        assert {round(r["shade"], 9) for r in raster.hillshade(flat, raster.Grid(0, 0, 1, -1, 4, 4), azimuths).collect()} == {round(math.cos(math.radians(45)), 9)}


def test_polygons_and_borders(spark):
    square = spark.createDataFrame([("B", 0, 0, 0.0, 0.0), ("B", 0, 1, 4.0, 0.0), ("B", 0, 2, 4.0, 4.0), ("B", 0, 3, 0.0, 4.0), ("A", 0, 0, 4.0, 0.0), ("A", 0, 1, 8.0, 0.0), ("A", 0, 2, 8.0, 4.0), ("A", 0, 3, 4.0, 4.0)], "poly_id string, ring int, seq int, x double, y double")
    pts = points(spark, [(2, 2), (4, 2), (9, 9), (0, 0)])
    edge = spatial.edges(square)
    assert {r["id"]: r["plate"] for r in spatial.assign_polygon(pts, edge).collect()} == {"0": "B", "1": "A", "2": None, "3": "B"}
    assert {r["id"] for r in spatial.clip(pts, edge).collect()} == {"0"}


def test_transverse_mercator_on_known_places(spark):
    x, y = G.transverse_mercator(F.lit(-117.0), F.lit(36.0), -117.0)
    x2, y2 = G.transverse_mercator(F.lit(-115.5), F.lit(36.0), -117.0)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), x2.alias("x2"), y2.alias("y2")).first()
    assert r["x"] == pytest.approx(500000) and r["y"] == pytest.approx(3983948.453, abs=0.01)  # 0.9996 of the meridian arc
    assert r["x2"] > 600000 and r["y2"] > r["y"]


def test_landing_and_transforms(spark):
    df = control(spark, [("a", -115.1, 36.1, 600.0, 2017.95, None, None, None, None, None)]).withColumn("horizontal_crs", F.lit("EPSG:7912"))
    got = landing.land(df).first()
    north = (got["y"] - 36.1) * 111_000
    east = (got["x"] + 115.1) * 111_320 * math.cos(math.radians(36.1))
    assert 0.5 < math.hypot(north, east) < 3.0 and got["height"] == 600.0 and got["transform_id"] == "EPSG:7912->EPSG:6318"
    early, late = (landing.transform_points(df, "EPSG:7912", "EPSG:6319", e).first() for e in (2015.0, 2025.0))
    apart = math.hypot((early["y"] - late["y"]) * 111_000, (early["x"] - late["x"]) * 111_320 * 0.808)
    assert 0.10 < apart < 0.30
    with pytest.raises(registry.NoTransformPath):
        landing.land(df.withColumn("horizontal_crs", F.lit("EPSG:4152")))
    with pytest.raises(ValueError):
        landing.transform_points(df, "EPSG:7912", "EPSG:6319")
    with pytest.raises(ValueError):
        landing.land(df.withColumn("coord_epoch", F.lit(None).cast("double")))
    same, shift = landing.transform_control(df, "EPSG:6319", registry.target_for("nad83_2011", -115.1, 36.1))
    assert same.first()["x"] == pytest.approx(671_000, abs=2_000) and shift.first()["median"] == 0
    assert registry.utm_zone("EPSG:6340") == "11N" and registry.utm_code("wgs84", 11, False) == "EPSG:32711"
    assert landing.in_area(179, 0, 170, -10, -170, 10) and not landing.in_area(0, 0, 170, -10, -170, 10)


def test_summary_keeps_empty_segments(spark):
    df = spark.createDataFrame([("opus", "gnss", 0.1), ("opus", None, None), (None, "NVA", 0.3)], "source string, point_type string, dh_DTM_before double")
    rows = {r["segment"]: r for r in A.summarize(df).collect()}
    assert rows["3DEP NVA"]["n"] == 0 and rows["GNSS/OPUS"]["n"] == 2 and rows["GNSS/OPUS"]["n_valid"] == 1 and rows["ALL"]["n"] == 3
    assert rows["3DEP VVA"]["applies"] is True


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 40_000])
def test_percentiles_are_the_exact_ones(spark, n):
    from plumbline.operators import quantiles

    rng = random.Random(n)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([rng.gauss(0, 1), rng.randint(0, 5), None])) for _ in range(n)] + [("empty", None)]
    df = spark.createDataFrame([(g, float(v) if v is not None else None) for g, v in rows], "g string, v double")
    wanted = {"p05": 0.05, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for by in (["g"], []):
        a = quantiles.percentiles(df, F.col("v"), by, wanted).collect()
        b = df.groupBy(*by).agg(*[F.percentile("v", F.lit(q)).alias(name) for name, q in wanted.items()]).collect()
        key = lambda r: str(r[0])
        if by or any(x is not None for x in b[0]):
            for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
                assert list(x) == [v if not isinstance(v, float) else pytest.approx(v, abs=1e-12) for v in y]
