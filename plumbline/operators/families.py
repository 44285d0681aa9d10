"""Classes of control: the best monuments, families of points with their products, gated description, review pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_text
from .stats import med_nmad, robust_normalize


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def best_monument() -> Column:
    """Monuments with an adjusted position and either the 2011 realization or a vertical that is adjusted or observed."""
    raw = F.col("raw")
    recent = F.replace(F.col("ref_frame"), F.lit(" "), F.lit("")) == "NAD83(2011)"
    vertical = json_text(raw, "vertSource").isin("GPS OBS", "ADJUSTED", "READJUSTED")
    return _sure(F.col("source") == "ngs") & _sure(json_text(raw, "posSource") == "ADJUSTED") & (_sure(recent) | _sure(vertical))


class Subclass(NamedTuple):
    family: str
    name: str
    predicate: Callable[[], Column]
    products: Sequence[str] | None = None


def _source(name: str, column: Callable[[], Column] | None = None, value: str | None = None) -> Callable[[], Column]:
    return lambda: _sure(F.col("source") == name) & (_sure(column() == value) if column else F.lit(True))


_point_type = lambda: F.col("point_type")
_pos_class = lambda: json_text(F.col("raw"), "pos_class")
#: Points of vegetated ground say nothing about a surface model.
FAMILIES = [
    Subclass("3dep", "NVA", _source("3dep", _point_type, "NVA")), Subclass("3dep", "VVA", _source("3dep", _point_type, "VVA"), ("DTM",)),
    Subclass("gnss", "GNSS/OPUS", _source("opus")), Subclass("ngs_best", "NGS best", best_monument),
    Subclass("faa", "Surveyed", _source("faa", _pos_class, "surveyed")), Subclass("faa", "Estimated", _source("faa", _pos_class, "estimated")),
]


def with_families(points: DataFrame, products: Sequence[str], families: Sequence[Subclass] = FAMILIES) -> DataFrame:
    """A row for each (point, product, family and subclass it is in); points of none go.  One pass, no join."""
    entries = [
        F.when(f.predicate(), F.struct(F.lit(p).alias("product"), F.lit(f.family).alias("family"), F.lit(f.name).alias("subclass")))
        for f in families for p in products if f.products is None or p in f.products
    ]
    return points.withColumn("__f", F.explode(F.array_compact(F.array(*entries)))).select("*", "__f.*").drop("__f")


def gated(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 3.0) -> DataFrame:
    """Values strictly inside k NMAD of their group's median; all of a group without spread."""
    rows = robust_normalize(df, value, by, k, "__in", flat=True)
    return rows.where("__in").drop("__in")


def gate_then_describe(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 3.0) -> DataFrame:
    """n, median and NMAD of what the strict gate leaves."""
    return med_nmad(gated(df, value, by, k), value, by)


def pages(df: DataFrame, order: str, per_page: int, classes: Mapping[str, int] | None = None, column: str | None = None) -> DataFrame:
    """``df`` with class_rank and page (both from 0): by class, then by ``order`` as text; unknown classes come last together; no page holds two classes."""
    rank = F.lit(len(classes or {}))
    if column and classes:
        known = F.create_map(*[F.lit(x) for item in classes.items() for x in item])
        rank = F.coalesce(F.try_element_at(known, F.col(column)), rank)
    out = df.withColumn("class_rank", rank.cast("int"))
    place = F.row_number().over(Window.partitionBy("class_rank").orderBy(F.col(order).cast("string")))
    return out.withColumn("page", F.floor((place - 1) / per_page).cast("int"))


def with_operations(points: DataFrame, records: DataFrame) -> DataFrame:
    """Each row with the record (transform_id, ...) of the operation that made it; rows without one keep nulls."""
    known = records.dropDuplicates(["transform_id"])
    return points.join(F.broadcast(known) if records.isLocal() else known, "transform_id", "left")
