"""Station index, daily position series, discontinuities and station velocities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesy import wrap_lon
from ..functions.time import decyear, decyear_inv, short_date
from ..operators.sizes import small_or_shuffled
from ..registry import ALIASES
from ..schema import empty, normalize
from .common import bounded, fields, lines_of, must

FRAMES = {k: v for k, v in ALIASES.items() if k in ("IGS20", "IGS14")}


def parse_index(lines: DataFrame) -> DataFrame:
    """Stations: name, position, span and counts; the original name may hold spaces or be absent."""
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("Sta "))).withColumn("p", fields(12))
    must(rows, F.size("p") >= 11, "the station index needs 11 fields")
    at = lambda i: bounded(F.col("p"), i)
    return rows.select(
        at(0).alias("sta"), at(1).cast("double").alias("lat"), wrap_lon(at(2).cast("double")).alias("lon"), at(3).cast("double").alias("hgt"),
        F.to_timestamp(at(7), "yyyy-MM-dd").alias("dtbeg"), F.to_timestamp(at(8), "yyyy-MM-dd").alias("dtend"),
        at(9).alias("dtmod"), at(10).cast("long").alias("num_sol"), F.coalesce(F.trim(at(11)), F.lit("")).alias("sta_orig_name"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_index(lines_of(spark, path))


_NEEDED = "date site latitude longitude height decyear sig_e sig_n sig_u ant".split()


def parse_series(lines: DataFrame) -> DataFrame:
    """Daily positions of any number of files; each file's header names its columns."""
    rows = lines.where(F.trim("value") != "").withColumn("p", fields())
    head = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where("n = 1").select("file", F.col("p").alias("head"), F.col("line_no").alias("head_line"), "value")
    clean = F.transform("head", lambda c: F.regexp_replace(F.regexp_replace(c, r"\(.*\)$", ""), "^_+", ""))
    head = head.withColumn("head", F.transform(clean, lambda c: F.when(c == "YYMMMDD", "date").when(c == "yyyy.yyyy", "decyear").otherwise(c)))
    needed = F.array(*[F.lit(c) for c in _NEEDED])
    lacking = head.where(F.size(F.array_except(needed, "head")) > 0).first()
    if lacking is not None:
        raise ValueError(f"{lacking['file']} lacks columns {sorted(set(_NEEDED) - set(lacking['head']))}")
    both = rows.join(small_or_shuffled(head.drop("value")), "file").where(F.col("line_no") > F.col("head_line"))
    both = both.withColumn("m", F.map_from_arrays("head", F.slice("p", F.lit(1), F.size("head"))))
    number = lambda c: F.col("m")[c].cast("double").alias(c)
    return both.select(
        F.col("m")["site"].alias("sta"), short_date(F.col("m")["date"]).alias("date"), number("decyear"), number("latitude"),
        wrap_lon(F.col("m")["longitude"].cast("double")).alias("longitude"), number("height"), number("ant"), number("sig_e"), number("sig_n"), number("sig_u"),
    )


def read_series(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    rows = parse_series(lines_of(spark, path))
    return rows.where(F.col("sta") == station.upper()) if station else rows


def parse_steps(lines: DataFrame) -> DataFrame:
    """Discontinuities: type 1 has an event, type 2 a threshold, distance, magnitude and event id."""
    rows = lines.where(F.trim("value") != "").withColumn("p", fields(4))
    must(rows, F.size("p") >= 4, "a step needs 4 fields")
    must(rows, bounded(F.col("p"), 2).isin("1", "2"), "a step is of type 1 or 2")
    rows = rows.withColumn("tail", F.split(F.trim(F.get("p", F.lit(3))), r"\s+", 4))
    must(rows, (F.get("p", F.lit(2)) == "1") | (F.size("tail") == 4), "an earthquake needs 4 more fields")
    quake = F.get("p", F.lit(2)) == "2"
    part = lambda i: F.when(quake, F.get("tail", F.lit(i)))
    return rows.select(
        F.get("p", F.lit(0)).alias("sta"), short_date(F.get("p", F.lit(1))).alias("date"), F.get("p", F.lit(2)).cast("int").alias("type"),
        F.when(~quake, F.trim(F.get("p", F.lit(3)))).alias("event"), part(0).cast("double").alias("threshold_km"),
        part(1).cast("double").alias("distance_km"), part(2).cast("double").alias("magnitude"), F.trim(part(3)).alias("event_id"),
    )


def read_steps(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    rows = parse_steps(lines_of(spark, path))
    return rows.where(F.col("sta") == station.upper()) if station else rows


_VELOCITY = (
    "sta version t0 t1 duration_yr n_epochs n_good n_pairs vel_e vel_n vel_u sig_vel_e sig_vel_n sig_vel_u off_e off_n off_u "
    "frac_out_e frac_out_n frac_out_u sd_pairs_e sd_pairs_n sd_pairs_u n_steps lat lon hgt"
).split()


def parse_velocities(lines: DataFrame) -> DataFrame:
    """Station velocities: 27 columns in every row, none missing."""
    rows = lines.where(F.trim("value") != "").withColumn("p", fields())
    must(rows, F.size("p") == len(_VELOCITY), f"a velocity row needs {len(_VELOCITY)} fields")
    numbers = F.forall(F.slice("p", F.lit(3), F.lit(25)), lambda x: x.try_cast("double").isNotNull() & ~F.isnan(x.try_cast("double")))
    must(rows, numbers, "a velocity row has a missing number")

    def column(i: int, name: str) -> Column:
        raw = F.get("p", F.lit(i))
        if name in ("sta", "version"):
            return raw.alias(name)
        value = raw.cast("double")
        return (value.cast("long") if name.startswith("n_") else wrap_lon(value) if name == "lon" else value).alias(name)

    return rows.select(*[column(i, c) for i, c in enumerate(_VELOCITY)])


def read_velocities(spark: SparkSession, path: str) -> DataFrame:
    return parse_velocities(lines_of(spark, path))


def select_stations(index: DataFrame, box: tuple[float, ...], epoch: float | None = None, span: tuple[float, float] | None = None, most: int | None = None) -> DataFrame:
    """Stations in a box whose data meet an epoch (30 days of slack) or a span of decimal years."""
    out = index.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    month = F.make_interval(days=F.lit(30))
    if span is not None:
        out = out.where((F.col("dtbeg") <= decyear_inv(F.lit(span[1]))) & (F.col("dtend") >= decyear_inv(F.lit(span[0]))))
    elif epoch is not None:
        when = decyear_inv(F.lit(float(epoch)))
        out = out.where((F.col("dtbeg") <= when + month) & (F.col("dtend") >= when - month))
    return out.orderBy("sta").limit(most) if most is not None else out


def select_window(series: DataFrame, epoch: float | None = None, span: tuple[float, float] | None = None, last: int = 30) -> tuple[DataFrame, str]:
    """The solutions to use: 30 days around an epoch, a span of years, or each station's last ones; and the mode's name."""
    if epoch is not None:
        when, reach = decyear_inv(F.lit(float(epoch))), F.make_interval(days=F.lit(30))
        return series.where(F.col("date").between(when - reach, when + reach)), "epoch"
    if span is not None:
        return series.where(F.col("date").between(decyear_inv(F.lit(span[0])), decyear_inv(F.lit(span[1])))), "time_range"
    rank = F.row_number().over(Window.partitionBy("sta").orderBy(F.desc("date"), "decyear", "latitude", "longitude", "height"))
    return series.withColumn("rn", rank).where(F.col("rn") <= last).drop("rn"), "last_n"


def median_lon(lon: Column) -> Column:
    """Median that doesn't break at the antimeridian."""
    return F.when(F.max(lon) - F.min(lon) > 180, wrap_lon(F.median(F.pmod(lon, F.lit(360.0))))).otherwise(F.median(lon))


def positions(window: DataFrame, mode: str = "last_n") -> DataFrame:
    """One position a station: medians, and the time of the solution nearest to the median epoch (the first of ties)."""
    med = window.groupBy("sta").agg(
        F.median("latitude").alias("lat"), median_lon(F.col("longitude")).alias("lon"), F.median("height").alias("height"),
        F.median("decyear").alias("coord_epoch"), F.median("sig_e").alias("sig_e_m"), F.median("sig_n").alias("sig_n_m"),
        F.median("sig_u").alias("sig_u_m"), F.median("ant").alias("ant_m"), F.count("*").alias("n_solutions_used"),
        F.min("date").alias("first_used"), F.max("date").alias("last_used"),
    )
    off = window.join(med.select("sta", F.col("coord_epoch").alias("mid")), "sta")
    when = off.groupBy("sta").agg(F.min_by("date", F.struct(F.round(F.abs(F.col("decyear") - F.col("mid")), 12), F.col("date"))).alias("measurement_datetime"))
    return med.join(when, "sta").withColumn("window", F.to_json(F.struct(F.lit(mode).alias("mode"), "first_used", "last_used")))


def parse(series: DataFrame, index: DataFrame, velocities: DataFrame | None = None, frame: str = "IGS14", epoch: float | None = None, span: tuple[float, float] | None = None) -> DataFrame:
    """Station control in its own dynamic frame; a station without solutions in the window is left out."""
    if frame not in FRAMES:
        raise ValueError(f"unknown frame {frame!r}; known: {sorted(FRAMES)}")
    chosen, mode = select_window(series, epoch, span)
    rows = positions(chosen, mode).join(index.select("sta", "sta_orig_name", "dtbeg", "dtend", "num_sol"), "sta", "left")
    columns = [prefix + axis for prefix in ("vel_", "sig_vel_") for axis in "enu"]
    if velocities is not None:
        rows = rows.join(velocities.select("sta", *columns), "sta", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in columns})
    code = F.lit(FRAMES[frame])
    raw = F.to_json(F.struct("sta_orig_name", "dtbeg", "dtend", "num_sol", "n_solutions_used", "window", "sig_e_m", "sig_n_m", "sig_u_m", "ant_m", *columns[3:]))
    out = rows.withColumns({
        "id": F.col("sta"), "point_type": F.lit("gnss"), "height_datum": F.lit("ellipsoidal"), "horizontal_crs": code, "vertical_crs": code,
        "ref_frame": F.lit(frame), "measurement_epoch": decyear(F.col("measurement_datetime")), "native_x": F.col("lon"), "native_y": F.col("lat"),
        "native_h": F.col("height"), "native_crs": code, "raw": raw, "x": F.col("lon"), "y": F.col("lat"),
    })
    return normalize(out, source="ngl") if rows is not None else empty(series.sparkSession)
