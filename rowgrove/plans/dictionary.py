"""Dictionaries of chunks: build, encode, decode, and whether one pays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizes import plain_bytes
from .ordinals import ORD, few
from .ordinals import group_keys as _keys

ID_BYTES = 2


def build(df: DataFrame, column: str) -> DataFrame:
    """(file, rg, id, value): distinct values of each chunk, ids dense from 0 by first appearance; nulls have none."""
    keys = _keys(df)
    first = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.min(ORD).alias("first"))
    return first.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).cast("long").alias("id"), "value")


def encode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """(file, rg, ord, id) of every row; null values keep a null id."""
    keys = _keys(df)
    return df.select(*keys, ORD, F.col(column).alias("value")).join(dictionary, [*keys, "value"], "left").select(*keys, ORD, "id")


def decode(ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(file, rg, ord, id, value): ids turned back to values."""
    keys = _keys(ids)
    return ids.join(dictionary, [*keys, "id"], "left").select(*keys, ORD, "id", "value")


def benefit(df: DataFrame, column: str) -> DataFrame:
    """(file, rg, num_rows, num_distinct, plain_bytes, dictionary_bytes, use_dictionary) of a column's chunks.

    A dictionary holds each distinct value in PLAIN form and two bytes per row; it is used where that is smaller than PLAIN
    and ids fit two bytes.
    """
    keys, field = _keys(df), df.schema[column]
    per_value = df.groupBy(*keys, column).agg(F.count("*").alias("n"), plain_bytes(field).alias("all_bytes"))
    one = F.when(F.col("n") > 0, F.col("all_bytes") / F.col("n")).cast("long")
    out = per_value.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("num_rows"), F.count(column).alias("num_distinct"), F.sum("all_bytes").cast("long").alias("plain_bytes"), F.sum(one).cast("long").alias("values_bytes")
    )
    out = out.withColumn("dictionary_bytes", F.col("values_bytes") + ID_BYTES * F.col("num_rows"))
    fits = F.col("num_distinct") <= 1 << (8 * ID_BYTES)
    return out.withColumn("use_dictionary", fits & (F.col("dictionary_bytes") < F.col("plain_bytes"))).drop("values_bytes")


def build_shared(df: DataFrame, column: str) -> DataFrame:
    """(id, value): one dictionary for all chunks of all files, ids dense from 0 in order of the values; small ones are broadcast where they are joined.

    Ids are numbered over distinct values, which a window sorts in one task, so it suits columns for which a dictionary makes sense at all.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return few(values.select((F.row_number().over(Window.orderBy("value")) - 1).cast("long").alias("id"), "value"))


def encode_shared(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with the shared ``id`` of a column's values."""
    return df.join(dictionary.withColumnRenamed("value", "_value"), F.col(column) == F.col("_value"), "left").drop("_value")
