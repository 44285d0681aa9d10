"""Exact percentiles of groups of any size.

Spark's exact percentile keeps all distinct values of a group in one task.  Here the value is found in two passes
that no group outgrows: a quantile sketch brackets the wanted ranks to about 1/1500 of the group, then the values inside
are counted where they lie, those outside in one row for each side, and only that histogram is ordered.  What each pass
finds, a row for each group, is kept, so plans built on percentiles of percentiles don't grow into each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import saved
from .sizes import small_or_shuffled

ACCURACY, MARGIN = 10_000, 3e-4


def matched(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a summary back, nulls in the keys being equal; with no keys it is one row."""
    renamed = right.toDF(*[f"__{c}" if c in by else c for c in right.columns])
    if not by:
        return left.crossJoin(F.broadcast(renamed))
    on = None
    for c in by:
        equal = left[c].eqNullSafe(renamed[f"__{c}"])
        on = equal if on is None else on & equal
    return left.join(small_or_shuffled(renamed), on, how).drop(*[f"__{c}" for c in by])


def percentiles(df: DataFrame, value: Column, by: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """A row for each group with a column for each wanted percentile; groups without values have nulls."""
    base = df.select(*by, value.cast("double").alias("__v"))
    limits = [x for q in wanted.values() for x in (max(q - MARGIN, 0.0), min(q + MARGIN, 1.0))]
    rough = base.groupBy(*by).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", limits, ACCURACY).alias("__b"))
    rough = saved(rough, "brackets")
    each = [
        F.struct(F.lit(i).alias("i"), F.get("__b", F.lit(2 * i)).alias("low"), F.get("__b", F.lit(2 * i + 1)).alias("high"), ((F.col("__n") - 1) * F.lit(q)).alias("at"))
        for i, q in enumerate(wanted.values())
    ]
    # missing values are taken out once they are counted: a filter here would go down through all that makes the value, and repeat it
    rows = matched(base, rough.where("__n > 0").select(*by, F.array(*each).alias("__each")), by)
    rows = rows.select(*by, "__v", F.explode("__each").alias("__q"))
    v, q, i = F.col("__v"), F.col("__q"), F.col("__q.i")
    side = F.when(v < q["low"], -1).when(v > q["high"], 1).otherwise(0)
    # counted on the map side: a row of each task, group and side is shuffled, and the values in the brackets
    counts = rows.groupBy(*by, i.alias("__i"), side.alias("__side"), F.when(side == 0, v).alias("__x")).agg(
        F.count("*").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.first(q["at"]).alias("__at")
    ).where("__most is not null")
    upto = F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy("__side", "__x"))
    placed = counts.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__c"))
    lower, upper = F.floor("__at"), F.ceil("__at")
    # a bracket's neighbours are the greatest value below it and the least above it
    near = F.when(F.col("__side") < 0, F.col("__most")).otherwise(F.col("__least"))
    holds = lambda k: F.max(F.when((F.col("__from") <= k) & (k < F.col("__to")), near))
    found = placed.groupBy(*by, "__i").agg(holds(lower).alias("__a"), holds(upper).alias("__z"), F.first("__at").alias("__at"))
    part = F.col("__at") - lower
    exact = F.when(upper == lower, F.col("__a")).otherwise((upper - F.col("__at")) * F.col("__a") + part * F.col("__z"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == k, exact)).alias(name) for k, name in enumerate(wanted)])
    groups = rough.select(*by) if by else df.sparkSession.range(1).select()
    return saved(matched(groups, wide, by, "left"), "percentiles")
