"""Published monument sheets and shared GNSS solutions, from JSON records of text fields."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import datum_crs, frame_epoch, frame_text, number_or_null, vertical_crs
from ..functions.time import decyear, mixed_date
from ..schema import normalize

ROWS_LIMIT, DEPTH_LIMIT, RETRIES = 500, 8, 3
Fetch = Callable[[tuple[float, float, float, float]], list[dict]]


def get_records(fetch: Fetch, box: tuple[float, ...], retries: int = RETRIES, sleep: Callable[[float], None] | None = None) -> list[dict]:
    """A request that must give a list; tried again after 1, 2, 4 seconds, then it raises."""
    import time

    for k in range(retries):
        got = fetch(box)
        if isinstance(got, list):
            return got
        (sleep or time.sleep)(2**k)
    raise RuntimeError(f"no list of records after {retries} tries")


def fetch_box(fetch: Fetch, box: tuple[float, float, float, float], overlap: float = 1e-6, depth: int = 0) -> list[dict]:
    """All records of a box: a full answer is split in four, slightly overlapping, down to a depth."""
    got = get_records(fetch, box)
    if len(got) < ROWS_LIMIT or depth >= DEPTH_LIMIT:
        return got
    x0, y0, x1, y1 = box
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    quarters = [(x0, y0, xm + overlap, ym + overlap), (xm - overlap, y0, x1, ym + overlap), (x0, ym - overlap, xm + overlap, y1), (xm - overlap, ym - overlap, x1, y1)]
    return [r for q in quarters for r in fetch_box(fetch, q, overlap, depth + 1)]


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """(arrival, value) with each record as JSON; missing keys stay missing."""
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "arrival long, value string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that hold a JSON array each."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    items = F.posexplode(F.from_json("value", "array<string>"))
    # a file and a place in it order records as a number would, without gathering them to number them
    return raw.select(F.struct("file", items).alias("r")).select(F.struct("r.file", "r.pos").alias("arrival"), F.col("r.col").alias("value"))


def dedupe_first(records: DataFrame, key: Column, order: str = "arrival") -> DataFrame:
    """The first record of each key; a blank key is dropped."""
    keyed = records.withColumn("__key", F.nullif(F.trim(key), F.lit(""))).where("__key is not null")
    rank = F.row_number().over(Window.partitionBy("__key").orderBy(order))
    return keyed.withColumn("__n", rank).where("__n = 1").drop("__n", "__key")


def field(name: str) -> Column:
    return F.get_json_object("value", f"$.{name}")


def quarantine(rows: DataFrame, datum: str = "ref_frame", crs: str = "horizontal_crs") -> tuple[DataFrame, DataFrame]:
    """Rows whose realization is known, and counts of the others by reason."""
    bad = rows.where(F.col(crs).isNull()).groupBy(F.coalesce(F.col(datum), F.lit("(missing)")).alias("reason")).agg(F.count("*").alias("n"))
    return rows.where(F.col(crs).isNotNull()), bad


_PLACED = set("lon lat orthoHt pid".split())


def _extras(consumed: set[str]) -> Column:
    """The record without the consumed keys, all values as text."""
    every = F.from_json("value", "map<string,string>")
    return F.to_json(F.map_filter(every, lambda k, v: ~k.isin(*consumed)))


def _common(records: DataFrame, datum: str) -> DataFrame:
    ref = frame_text(field(datum))
    lat, lon, height = (number_or_null(field(c)) for c in ("lat", "lon", "orthoHt"))
    return records.withColumns({
        "id": field("pid"), "height": height, "horizontal_crs": datum_crs(ref), "ref_frame": ref, "frame_epoch": frame_epoch(ref),
        "coord_epoch": F.coalesce(number_or_null(field("epoch")), frame_epoch(ref)), "native_h": height, "native_y": lat, "native_x": lon,
        "native_crs": F.concat(datum_crs(ref), F.lit("+5703")), "x": lon, "y": lat,
    })


def parse_sheets(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Monuments in the schema, and what was quarantined."""
    rows = _common(records, "posDatum").withColumns({
        "point_type": F.lit("monument"), "height_datum": field("vertDatum"), "vertical_crs": vertical_crs(field("vertDatum")),
        "measurement_datetime": mixed_date(field("lastRecovered")), "measurement_epoch": decyear(mixed_date(field("lastRecovered"))),
        "acc_h": number_or_null(field("netAccHz")) / 100, "raw": _extras(_PLACED | {"lastRecovered"}),
    })
    good, bad = quarantine(rows)
    return normalize(good, source="ngs"), bad


def parse_solutions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared GNSS solutions in the schema, and what was quarantined."""
    when = F.try_to_timestamp(field("obsTimeStart"))
    rows = _common(records, "refFrame").withColumns({
        "point_type": F.lit("gnss"), "height_datum": F.lit("NAVD88"), "vertical_crs": F.lit("EPSG:5703"), "measurement_datetime": when,
        "measurement_epoch": decyear(when), "acc_h": F.greatest(number_or_null(field("latP2p")), number_or_null(field("lonP2p"))),
        "acc_v": number_or_null(field("orthoHtP2p")), "raw": _extras(_PLACED | {"obsTimeStart"}),
    })
    good, bad = quarantine(rows)
    return normalize(good, source="opus"), bad
