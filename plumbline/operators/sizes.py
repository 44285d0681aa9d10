"""A side of a join is broadcast only where Spark's own statistics call it small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a relation's size, from file sizes and counts; huge where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def leaf_bytes(df: DataFrame) -> int:
    """The sizes of all relations a plan reads; unlike the estimate of its result, joins don't multiply it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def small_or_shuffled(df: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint while its estimated size is within the limit, else for a shuffled join."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df
