"""Queries over whole tables, larger than those of the smallest scale."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.queries import oracle_sql, queries

from .conftest import SF

PARTS = 5000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The smallest scale with a part table of 5,000 rows."""
    d = str(tmp_path_factory.mktemp("large"))
    for name in os.listdir(SF):
        if name != "part.parquet":
            os.symlink(f"{SF}/{name}", f"{d}/{name}")
    k = F.col("id")
    spark.range(PARTS).select(k.alias("p_partkey"), (900 + k % 1000 / 10).alias("p_retailprice")).write.parquet(f"{d}/part.parquet")
    return d


def both(spark, d, name):
    c = duckdb.connect()
    for t in ("part", "orders", "events"):
        path = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = queries()[name](spark, d)
    columns = sorted(df.columns)
    first = [c for c, t in df.dtypes if t != "double"]
    order = lambda row: tuple(str(row[x]) for x in first)
    got = sorted((r.asDict() for r in df.collect()), key=order)
    found = c.execute(oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    return got, sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=order)


def same(got, want):
    """Equal but for the last digit, where sums in another order are rounded apart."""
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for c, x in a.items():
            assert x == b[c] or (isinstance(x, float) and b[c] is not None and abs(x - b[c]) <= 2e-6), (a, b)


RASTERS = ["raster_nearest", "raster_linear", "raster_nodata_gap", "raster_radius", "hillshade", "sample_products", "assess_end_to_end"]


@pytest.mark.parametrize("name", RASTERS)
def test_whole_rasters_equal_sql_beyond_2000_parts(spark, large, name):
    got, want = both(spark, large, name)
    same(got, want)
    if name == "hillshade":
        assert len(got) == PARTS


def test_whole_longitudes_and_windows_take_every_event(spark, large):
    """Every event counts, also those with event_id % 3 > 0 or over five days from the epoch."""
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    for name in ("median_lon_antimeridian", "window_epoch_30d"):
        same(*both(spark, large, name))
    assert sum(r["n"] for r in queries()["window_epoch_30d"](spark, SF).collect()) == n


def test_every_point_is_projected_in_its_own_zone(spark):
    from plumbline.plans.catalogue import control

    rows = {r["id"]: r for r in queries()["utm_projection"](spark, SF).collect()}
    points = control(spark, SF).collect()
    assert len(rows) == len(points) and len({r["zone"] for r in rows.values()}) > 1
    for p in points:
        got = rows[p["id"]]
        assert got["zone"] == int((p["x"] + 180) // 6) + 1
        off = math.radians(p["x"] - (got["zone"] * 6 - 183)) * math.cos(math.radians(p["y"])) * 6378137
        assert abs(got["easting"] - 5e5 - off) < 2500
