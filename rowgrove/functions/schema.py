"""Flat schemas: validation, column handles, physical and logical types, fixed lengths and required columns.

A table is flat: atomic columns only, each required or optional. Spark reads every column back as nullable and forgets
the length of fixed binaries, so both are kept in ``StructField.metadata`` and checked against the data on request.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED_LENGTH, REQUIRED = "fixed_length", "required"

#: Physical type by Spark type.
PHYSICAL = {
    "boolean": "BOOLEAN", "tinyint": "INT32", "smallint": "INT32", "int": "INT32", "date": "INT32", "bigint": "INT64",
    "timestamp": "INT64", "timestamp_ntz": "INT64", "float": "FLOAT", "double": "DOUBLE", "string": "BYTE_ARRAY", "binary": "BYTE_ARRAY",
}

#: Logical types that Spark's scan refuses; their chunks are read through the footer source's Arrow path instead.
ARROW_ONLY = ("FLOAT16", "UUID", "TIME(MILLIS)", "TIME(NANOS)", "TIMESTAMP(NANOS)")


class SchemaError(ValueError):
    """A table or schema that isn't what the operator needs."""


def validate_flat_schema(schema: T.StructType) -> T.StructType:
    """Refuse nested columns, repeated names and fixed binaries without a positive length."""
    nested = [f.name for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) or f.dataType.simpleString() == "variant"]
    if nested:
        raise SchemaError(f"nested columns aren't supported: {', '.join(nested)}")
    names = [f.name for f in schema.fields]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise SchemaError(f"columns named more than once: {', '.join(twice)}")
    bad = [f.name for f in schema.fields if FIXED_LENGTH in (f.metadata or {}) and f.metadata[FIXED_LENGTH] <= 0]
    if bad:
        raise SchemaError(f"fixed lengths must be positive: {', '.join(bad)}")
    return schema


def is_flat(schema: T.StructType) -> bool:
    try:
        validate_flat_schema(schema)
    except SchemaError:
        return False
    return True


def descriptor(schema: T.StructType, name: str) -> T.StructField | None:
    """Column handle by name; None where there is none."""
    return next((f for f in schema.fields if f.name == name), None)


def descriptor_at(schema: T.StructType, i: int) -> T.StructField:
    if not 0 <= i < len(schema.fields):
        raise IndexError(f"column {i} of {len(schema.fields)}")
    return schema.fields[i]


def physical_type(kind: T.DataType) -> str:
    """Physical Parquet type that Spark writes for a Spark type."""
    if isinstance(kind, T.DecimalType):
        return "INT32" if kind.precision <= 9 else "INT64" if kind.precision <= 18 else "FIXED_LEN_BYTE_ARRAY"
    try:
        return PHYSICAL[kind.simpleString().split("(")[0]]
    except KeyError:
        raise SchemaError(f"no flat physical type for {kind.simpleString()}") from None


def fixed_binary(name: str, length: int, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.BinaryType(), nullable, {FIXED_LENGTH: length})


def required(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, False, {REQUIRED: True})


def with_declared(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Put declared metadata (required, fixed lengths) back on columns that a scan has read."""
    kept = {f.name: f.metadata for f in declared.fields}
    return df.select(*[F.col(c).alias(c, metadata=kept.get(c) or {}) for c in df.columns])


def violations(df: DataFrame, declared: T.StructType | None = None) -> DataFrame:
    """One row (column, rule, rows) for each declared rule that rows break; a single aggregate over the table."""
    schema = declared or df.schema
    rules = []
    for f in schema.fields:
        if not f.nullable or (f.metadata or {}).get(REQUIRED):
            rules.append((f.name, "required", F.count_if(F.col(f.name).isNull())))
        if n := (f.metadata or {}).get(FIXED_LENGTH):
            rules.append((f.name, f"length {n}", F.count_if(F.octet_length(f.name) != n)))
    spark = df.sparkSession
    if not rules:
        return spark.createDataFrame([], "`column` string, rule string, rows long")
    counted = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), n.alias("rows")) for c, r, n in rules]).alias("all"))
    return counted.select(F.inline("all")).where("rows > 0")


def require(df: DataFrame, declared: T.StructType) -> DataFrame:
    """``df`` if it keeps the declared rules; a SchemaError otherwise."""
    broken = violations(df, declared).collect()
    if broken:
        raise SchemaError("; ".join(f"{r['column']}: {r['rows']} rows break {r['rule']}" for r in broken))
    return df


def schema_relation(df: DataFrame, table: str) -> DataFrame:
    """The schema as rows (table, position, column, type, physical)."""
    rows = [(table, i, f.name, f.dataType.simpleString(), physical_type(f.dataType) if is_flat(T.StructType([f])) else None) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "`table` string, position long, `column` string, type string, physical string")


def same_columns(found: Sequence[str], wanted: Iterable[str]) -> None:
    """Set equality of columns, as an assembled or written row group needs it."""
    wanted = list(wanted)
    missing, extra = [c for c in wanted if c not in found], [c for c in found if c not in wanted]
    if missing or extra:
        raise SchemaError("; ".join(filter(None, [f"missing: {', '.join(missing)}" if missing else "", f"not in the schema: {', '.join(extra)}" if extra else ""])))
