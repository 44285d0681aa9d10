"""The stateless stages on a stream of control records: the same functions, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.landing import LANDING, land
from ..operators.stats import error_report
from ..schema import normalize


def landed(stream: DataFrame, datums: list[str], source: str | None = None) -> DataFrame:
    """A stream in the schema, landed; the datums are named, as a stream can't be asked for them."""
    return normalize(land(normalize(stream, source), LANDING, datums), source)


def report_each_batch(stream: DataFrame, value: str, by: list[str], path: str) -> DataStreamWriter:
    """Exact statistics are holistic, so each micro-batch gets its own report, in a folder by its number (writes can repeat)."""

    def run(batch: DataFrame, number: int) -> None:
        error_report(batch, value, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run)
