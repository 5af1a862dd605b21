"""Incremental append: files that arrive in a folder are added to a table, each once, with a chosen layout."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.schema import validate_flat_schema
from ..sources.writer import write_options


def append_arrivals(spark: SparkSession, schema: StructType, arrivals: str, table: str, checkpoint: str, **layout) -> StreamingQuery:
    """Append all files that have arrived and stop; the checkpoint remembers which were added."""
    validate_flat_schema(schema)
    stream = spark.readStream.schema(schema).parquet(arrivals)
    return stream.writeStream.format("parquet").options(**write_options(**layout)).option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
