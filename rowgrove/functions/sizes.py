"""Sizes of values under PLAIN encoding, computed from the values alone (so they are the same in any engine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC_BYTES = 4
WIDTH = {"INT32": 4, "INT64": 8, "FLOAT": 4, "DOUBLE": 8}


def plain_bytes(field: T.StructField) -> Column:
    """Aggregate: PLAIN bytes of a column's values; nulls take none."""
    from .schema import FIXED_LENGTH, physical_type

    c = F.col(field.name)
    if n := (field.metadata or {}).get(FIXED_LENGTH):
        return (F.count(c) * n).cast("long")
    kind = physical_type(field.dataType)
    if kind == "BOOLEAN":
        return F.ceil(F.count(c) / 8).cast("long")
    if kind in WIDTH:
        return (F.count(c) * WIDTH[kind]).cast("long")
    return F.coalesce(F.sum(F.octet_length(c) + 4), F.lit(0)).cast("long")
