"""Shared plumbing of the training-data operators: table access, code shipping, checkpoints."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import reliable as reliable
from ..functions.shipping import ship as ship_code

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, whatever store the path is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(c, UPPER, LOWER)


#: Rows in an Arrow batch of documents: a batch and its copies stay small beside a worker's memory, whole texts included.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path, and keep Arrow batches small.

    A batch size that the session has set itself stays.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    ship_code(spark)


#: Rows of a narrow table (a few numbers each) that is broadcast; it is counted first, and joined by a shuffle beyond that.
BROADCAST_ROWS = 200_000


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def relieve() -> None:
    """In a Python worker: give freed memory back to the system, since several workers share an executor's allowance."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := _malloc_trim()) is not None:
        trim(0)


@functools.lru_cache(maxsize=1)
def _malloc_trim():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None
