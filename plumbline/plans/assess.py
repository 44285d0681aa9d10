"""The assessment: control, into the products' frame, sampled, residuals, statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..io import stats_csv
from ..operators.landing import transform_control
from ..operators.raster import Grid, sample_products
from ..operators.stats import summarize


def assess(
    control: DataFrame, rasters: Mapping[str, tuple[DataFrame, Grid]], source: str, target: str, epoch: float = 2010.0,
    method: str = "linear", metres: float | None = None, out_dir: str | None = None, key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(sampled control, statistics by product and segment); with ``out_dir`` both are written."""
    if metres is not None and method != "linear":
        raise ValueError("a radius excludes a method")
    landed, _ = transform_control(control, source, target, epoch)
    sampled = sample_products(landed, rasters, key, "h_ell", method, metres)
    if out_dir:
        sampled.write.mode("overwrite").parquet(f"{out_dir}/sampled.parquet")
        sampled = control.sparkSession.read.parquet(f"{out_dir}/sampled.parquet")
    summary = summarize(sampled, list(rasters))
    if out_dir:
        stats_csv(summary, f"{out_dir}/stats.csv")
    return sampled, summary
