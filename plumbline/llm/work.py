"""Where the operators keep tables between jobs, and the size check before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if rows x bytes a row stay below this.
BROADCAST_BYTES = 32 << 20
ROWS_AT_ONCE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where the setting is missing and there is one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``df`` (a saved table) marked for broadcast if its counted size is small, else as it is, for a shuffled join.

    ``bytes_per_row`` is what a row takes in a hashed relation: its words, its key again, and pointers.
    """
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Apply ``fn`` to each Arrow batch, ``ROWS_AT_ONCE`` rows at a time: what it needs besides is bounded by that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield fn(batch.slice(lo, rows))

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
