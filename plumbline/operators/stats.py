"""Robust and parametric accuracy statistics.

All take a value column and grouping columns; missing and non-finite values never count,
groups with none of them stay, with n = 0 and null statistics.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import finite, is_finite
from ..store import saved
from .quantiles import matched, percentiles

NMAD = 1.4826
GATE = 3.0


def with_med_nmad(df: DataFrame, value: str, by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """``df`` with the median and NMAD of its group in <prefix>median and <prefix>nmad."""
    v = finite(F.col(value))
    med = percentiles(df, v, by, {f"{prefix}median": 0.5})
    joined = matched(df, med, by)
    off = percentiles(joined, F.abs(v - F.col(f"{prefix}median")), by, {f"{prefix}nmad": 0.5})
    return matched(joined, off, by).withColumn(f"{prefix}nmad", F.lit(NMAD) * F.col(f"{prefix}nmad"))


def med_nmad(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    joined = with_med_nmad(df, value, by)
    return joined.groupBy(*by).agg(F.count(finite(F.col(value))).alias("n"), F.first("median").alias("median"), F.first("nmad").alias("nmad"))


def resid_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, median, mean, nmad, population std and rmse."""
    v = finite(F.col(value))
    joined = with_med_nmad(df, value, by)
    return joined.groupBy(*by).agg(
        F.count(v).alias("n"), F.first("median").alias("median"), F.avg(v).alias("mean"), F.first("nmad").alias("nmad"),
        F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rmse"),
    )


def gate(v: Column, median: Column, nmad: Column, k: float = GATE) -> Column:
    """Inside k NMAD, bounds included; without spread nothing is gated."""
    return is_finite(v) & ((nmad == 0) | (F.abs(v - median) <= k * nmad))


def error_report(df: DataFrame, value: str, by: Sequence[str] = (), k: float = GATE) -> DataFrame:
    """Robust figures over everything finite, then parametric ones of what the gate keeps."""
    v = F.col(value)
    joined = with_med_nmad(df, value, by)
    used = F.when(gate(v, F.col("median"), F.col("nmad"), k), v)
    n, n_used = F.count(finite(v)), F.count(used)
    wanted = {"le90": 0.9, "le95": 0.95}
    moments = joined.groupBy(*by).agg(
        n.alias("n"), F.first("median").alias("median"), F.first("nmad").alias("nmad"), n_used.alias("n_used"),
        (n - n_used).alias("n_outliers"), F.avg(used).alias("mean"), F.stddev_samp(used).alias("std"),
        F.sqrt(F.avg(used * used)).alias("rmse"),
    )
    return matched(moments, percentiles(joined, F.abs(used), by, wanted), by)


def robust_normalize(df: DataFrame, value: str, by: Sequence[str] = (), k: float = GATE, out: str = "inlier", flat: bool = False) -> DataFrame:
    """``df`` with a boolean: strictly inside k NMAD of the median; so all false where there is no spread, or all true with ``flat``."""
    joined = with_med_nmad(df, value, by)
    v = finite(F.col(value))
    inside = (v > F.col("median") - k * F.col("nmad")) & (v < F.col("median") + k * F.col("nmad"))
    if flat:
        inside = inside | (v.isNotNull() & (F.col("nmad") == 0))
    return joined.withColumn(out, F.coalesce(inside, F.lit(False))).drop("median", "nmad")


def ce90(df: DataFrame, dx: str, dy: str, by: Sequence[str] = (), k: float = GATE) -> DataFrame:
    """90 % circular error of pairs that both gates keep; medians are those of all finite pairs."""
    both = is_finite(F.col(dx)) & is_finite(F.col(dy))
    pairs = df.select(*by, F.when(both, F.col(dx)).alias("dx"), F.when(both, F.col(dy)).alias("dy"))
    pairs = with_med_nmad(with_med_nmad(pairs, "dx", by, "x_"), "dy", by, "y_")
    keep = gate(F.col("dx"), F.col("x_median"), F.col("x_nmad"), k) & gate(F.col("dy"), F.col("y_median"), F.col("y_nmad"), k)
    used = F.when(keep, F.hypot("dx", "dy"))
    counts = pairs.groupBy(*by).agg(F.count("dx").alias("n"), F.count(used).alias("n_used"))
    return matched(counts, percentiles(pairs, used, by, {"ce90": 0.9}), by)


TIERS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def snap_limit(df: DataFrame, value: str, by: Sequence[str] = (), k: float = GATE, tiers: Sequence[float] = TIERS) -> DataFrame:
    """The smallest tier that holds |median| + k max(nmad, 1e-6), else the last; the first for no values."""
    need = F.abs("median") + k * F.greatest(F.col("nmad"), F.lit(1e-6))
    limit = F.when(F.col("n") == 0, F.lit(float(tiers[0])))
    for tier in tiers:
        limit = limit.when(need <= tier, F.lit(float(tier)))
    return med_nmad(df, value, by).withColumn("limit", limit.otherwise(F.lit(float(tiers[-1]))))


Predicate = Callable[[], Column]


def _is(source: str, point_type: str | None = None) -> Predicate:
    def mask() -> Column:
        found = F.col("source") == source
        return found & (F.col("point_type") == point_type) if point_type else found

    return mask


#: label -> (rows, applies to surface models, applies to terrain models)
SEGMENTS: dict[str, tuple[Predicate, bool, bool]] = {
    "NGS monument": (_is("ngs"), True, True),
    "GNSS/OPUS": (_is("opus"), True, True),
    "3DEP VVA": (_is("3dep", "VVA"), False, True),
    "3DEP NVA": (_is("3dep", "NVA"), True, True),
}
ALL = "ALL"


def summarize(
    sampled: DataFrame, products: Sequence[str] | None = None, segments: dict[str, tuple[Predicate, bool, bool]] | None = None
) -> DataFrame:
    """A row for every (product, segment) and ALL, of residuals in dh_<product>_before; empty segments too."""
    segments = SEGMENTS if segments is None else segments
    if products is None:
        products = [m[1] for m in (re.fullmatch("dh_(.+)_before", c) for c in sampled.columns) if m]
    spark = sampled.sparkSession
    masks = [F.when(F.coalesce(mask(), F.lit(False)), F.lit(label)) for label, (mask, _, _) in segments.items()]
    long = F.explode(F.array(*[F.struct(F.lit(p).alias("product"), F.col(f"dh_{p}_before").cast("double").alias("dh")) for p in products]))
    label = F.explode(F.array_compact(F.array(*masks, F.lit(ALL))))
    # the statistics pass over these rows several times
    rows = saved(sampled.select(label.alias("segment"), "*").select("segment", long.alias("r")).select("segment", "r.product", "r.dh"), "residuals")
    report = error_report(rows, "dh", ("product", "segment"))
    masked = rows.groupBy("product", "segment").agg(F.count("*").alias("rows"))
    flags = {label: (dsm, dtm) for label, (_, dsm, dtm) in segments.items()} | {ALL: (True, True)}
    grid = [(p, s, bool(flags[s][1] if "DTM" in p.upper() else flags[s][0])) for p in products for s in flags]
    base = spark.createDataFrame(grid, "product string, segment string, applies boolean")
    out = F.broadcast(base).join(report, ["product", "segment"], "left").join(masked, ["product", "segment"], "left")
    if "xform_acc_m" in sampled.columns:
        # one row
        out = out.crossJoin(F.broadcast(percentiles(sampled, finite(F.col("xform_acc_m")), (), {"xform_acc_m": 0.5})))
    else:
        out = out.withColumn("xform_acc_m", F.lit(None).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "product", "segment", zero(F.col("rows")).alias("n"), zero(F.col("n")).alias("n_valid"), zero(F.col("n_outliers")).alias("n_out"),
        F.col("median").alias("median_m"), F.col("nmad").alias("nmad_m"), F.col("mean").alias("mean_m"), F.col("std").alias("std_m"),
        F.col("rmse").alias("rmse_m"), F.col("le90").alias("le90_m"), F.col("le95").alias("le95_m"), "xform_acc_m", "applies",
    )


def histogram(df: DataFrame, value: str, limit: float, bins: int = 41, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins of values clipped to +-limit; bins are numbered from 1."""
    v = finite(F.col(value))
    clipped = F.least(F.greatest(v, F.lit(-limit)), F.lit(limit))
    bucket = F.least(F.floor((clipped + limit) / (2 * limit / bins)) + 1, F.lit(bins))
    return df.where(v.isNotNull()).groupBy(*by, bucket.alias("bin")).agg(F.count("*").alias("n"))


def stretch(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Percentile limits, one column for each quantile: q_<per mille>."""
    v = finite(F.col(value))
    return percentiles(df, v, by, {f"q_{round(q * 1000)}": q for q in quantiles})


def top_or_other(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Counts of the n most frequent categories and of the others; blank and null are (none)."""
    from pyspark.sql import Window

    named = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("(none)"))
    counts = df.groupBy(named.alias("category")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "category"))
    label = F.when(F.col("rank") <= n, F.col("category")).otherwise("other")
    return counts.withColumn("rank", rank).groupBy(label.alias("category")).agg(F.sum("n").alias("n"))


def before_after(df: DataFrame, before: str, after: str) -> DataFrame:
    """Least, median and greatest finite shift between two columns."""
    d = finite(F.col(after) - F.col(before))
    ends = df.agg(F.min(d).alias("min"), F.max(d).alias("max"))
    return ends.crossJoin(F.broadcast(percentiles(df, d, (), {"median": 0.5}))).select("min", "median", "max")


def centroids(df: DataFrame, id_column: str, x: str, y: str) -> DataFrame:
    """Mean position by the part of the id before its first underscore."""
    return df.groupBy(F.split(id_column, "_")[0].alias("facility")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))


def valid_fraction(df: DataFrame, bands: Sequence[str], by: Sequence[str] = (), zero_is_missing: bool = False) -> DataFrame:
    ok = F.lit(True)
    for band in bands:
        ok = ok & is_finite(F.col(band))
    if zero_is_missing:
        some = F.lit(False)
        for band in bands:
            some = some | F.coalesce(F.col(band) != 0, F.lit(False))
        ok = ok & some
    return df.groupBy(*by).agg(F.avg(ok.cast("double")).alias("valid_fraction"))
