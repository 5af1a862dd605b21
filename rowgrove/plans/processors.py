"""Scans by callback: chunk by chunk, row group by row group, and raw bytes of chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.footer import bytes_of_ranges
from .ordinals import ORD, POS, RG
from .ordinals import group_keys as _keys


def scan_chunks(df: DataFrame, columns: list[str], text: Callable[[str], Column] = lambda c: F.col(c).cast("string")) -> DataFrame:
    """Values chunk by chunk: rows (file, rg, column_no, column, ord, value), values as text."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("column_no"), F.lit(c).alias("column"), text(c).alias("value")) for i, c in enumerate(columns)])
    return df.select(*_keys(df), ORD, F.explode(each).alias("v")).select(*_keys(df), "v.column_no", "v.column", ORD, "v.value")


def chunk_summary(df: DataFrame, columns: list[str], text: Callable[[str], Column] = lambda c: F.col(c).cast("string")) -> DataFrame:
    """(rg, column, num_values, num_nulls, min_text, max_text) of every chunk, in one aggregate over the row groups."""
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("num_values"), F.count_if(F.col(c).isNull()).alias("num_nulls"),
            F.min(text(c)).alias("min_text"), F.max(text(c)).alias("max_text"),
        )
        for c in columns
    ]
    return df.groupBy(*_keys(df)).agg(F.array(*parts).alias("all")).select(*_keys(df), F.inline("all"))


def process_row_groups(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``fn`` with the rows of each row group, in order; its results are the rows of ``schema``."""

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        return fn(group.sort_values(ORD, kind="stable", ignore_index=True))

    ship(df.sparkSession)
    return df.groupBy(*_keys(df)).applyInPandas(ordered, schema)


def process_chunks(df: DataFrame, columns: list[str], fn: Callable[[int, str, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``fn(rg, column, values)`` with each chunk: row group by row group, columns in the given order."""

    def chunks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ORD, kind="stable", ignore_index=True)
        return pd.concat([fn(int(group[RG].iloc[0]), c, group[c]) for c in columns], ignore_index=True)

    ship(df.sparkSession)
    kept = [c for c in dict.fromkeys([*_keys(df), ORD, POS, *columns]) if c in df.columns]
    return df.select(*kept).groupBy(*_keys(df)).applyInPandas(chunks, schema)


def raw_chunks(chunks: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Compressed bytes of chunks: (path, row_group, column, start, length, bytes), by one ranged read each; ``more`` columns are kept.

    ``chunks`` is the footer relation or a part of it. To open one chunk's bytes again and again see ``sources.chunks.file_chunk``.
    """
    asked = chunks.select("path", "row_group", "column", "start", F.col("length").alias("n"), *more)
    return bytes_of_ranges(asked).withColumnRenamed("n", "length")
