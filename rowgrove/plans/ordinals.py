"""Row ordinals and row groups.

The position of a row is (file, ordinal): ``_metadata.row_index`` is the ordinal that Spark's scan gives within a file, whatever the splits.
``table_ordinals`` makes it one ordinal over all files. A row group is a stretch of ordinals: physical ones come from the footers, logical ones from a
number of rows; it is named by (file, rg) where there is a ``file``, else by rg alone, and ``number_groups`` counts the groups of all files through.
Everything is arithmetic on those columns, so no operator here numbers rows by sorting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import uri

FILE, ORD, RG, POS = "file", "ord", "rg", "pos_in_rg"
#: Footer rows up to this number (about 100 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class RangeError(ValueError):
    """A row, row group or skip outside the table."""


def with_ordinal(df: DataFrame, *, file: str = FILE, ordinal: str = ORD) -> DataFrame:
    """Add the file and the 0-based ordinal in it to a Parquet scan."""
    return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(ordinal))


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns of a Parquet table with file and ordinal; only those columns are read."""
    df = spark.read.parquet(path)
    return with_ordinal(df) if columns is None else df.select(*columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ORD))


def group_keys(df: DataFrame) -> list[str]:
    """The columns that name a row group."""
    return [k for k in (FILE, RG) if k in df.columns]


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A relation of files or row groups, broadcast if it is small; it is counted first."""
    return F.broadcast(df) if df.count() <= rows else df


def _before(*keys: str, order: str | list[str]):
    """All rows before this one within ``keys``: a window over files or row groups, never over rows of a table."""
    window = Window.partitionBy(*keys) if keys else Window
    return (window.orderBy(*([order] if isinstance(order, str) else order))).rowsBetween(Window.unboundedPreceding, -1)


def table_ordinals(df: DataFrame) -> DataFrame:
    """A scan's rows with one ordinal over all files, which follow each other in order of their names; ``file`` is dropped.

    Only row counts of the files are summed up (Spark takes them from footers); rows aren't sorted.
    """
    if FILE not in df.columns:
        return df
    if len(df._jdf.inputFiles()) == 1:
        return df.drop(FILE)
    counts = df.groupBy(FILE).agg(F.count("*").alias("_rows"))
    starts = counts.select(FILE, F.coalesce(F.sum("_rows").over(_before(order=FILE)), F.lit(0)).alias("_start"))
    return df.join(few(starts), FILE).withColumn(ORD, F.col(ORD) + F.col("_start")).drop("_start", FILE)


def group_of(ordinal: Column, rows_per_group: int) -> Column:
    """Logical row group of an ordinal."""
    return F.floor(ordinal / F.lit(rows_per_group)).cast("long")


def logical_groups(df: DataFrame, rows_per_group: int) -> DataFrame:
    """Add the logical row group and the position in it."""
    if rows_per_group < 1:
        raise RangeError("a row group has at least one row")
    return df.withColumns({RG: group_of(F.col(ORD), rows_per_group), POS: F.col(ORD) % rows_per_group})


def physical_groups(df: DataFrame, row_groups: DataFrame) -> DataFrame:
    """Add the physical row group and the position in it, from footers (path, row_group, start_row, num_rows).

    A range join, made an equi-join: ordinals and row groups meet in buckets of the mean group's width, each group standing in the buckets it overlaps.
    """
    mean, groups = row_groups.where("num_rows > 0").agg(F.avg("num_rows"), F.count("*")).first()
    width = max(1, int(mean or 1))
    spans = row_groups.where("num_rows > 0").select(
        uri(F.col("path")).alias("_path"), F.col("row_group").cast("long").alias(RG), "start_row", (F.col("start_row") + F.col("num_rows")).alias("_end")
    ).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_row") / width), F.floor((F.col("_end") - 1) / width))))
    spans = F.broadcast(spans) if groups <= BROADCAST_ROWS else spans
    met = (uri(df[FILE]) == spans["_path"]) & (F.floor(df[ORD] / width) == spans["_bucket"]) & (df[ORD] >= spans["start_row"]) & (df[ORD] < spans["_end"])
    return df.join(spans, met).withColumn(POS, F.col(ORD) - F.col("start_row")).drop("_path", "_bucket", "_end", "start_row")


def row_group_index(df: DataFrame) -> DataFrame:
    """(file, rg, start_row, num_rows): prefix sums of the row counts of each file's groups (of all groups where there is no ``file``)."""
    keys = group_keys(df)
    counts = df.groupBy(*keys).agg(F.count("*").alias("num_rows"))
    start = F.coalesce(F.sum("num_rows").over(_before(*keys[:-1], order=RG)), F.lit(0)).cast("long")
    return counts.withColumn("start_row", start).select(*keys, "start_row", "num_rows")


def number_groups(index: DataFrame) -> DataFrame:
    """``index`` with group_no (from 0, through all files in order) and table_start (rows of all groups before)."""
    order = group_keys(index)
    number = F.row_number().over(Window.orderBy(*order)) - 1
    return index.withColumns({"group_no": number.cast("long"), "table_start": F.coalesce(F.sum("num_rows").over(_before(order=order)), F.lit(0)).cast("long")})


def check_index(index: DataFrame, total_rows: int) -> DataFrame:
    """``index`` if its row counts add up to the footer's total."""
    found = index.agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0]
    if found != total_rows:
        raise RangeError(f"row groups hold {found} rows, the footer says {total_rows}")
    return index


def start_of_group(index: DataFrame, group: int, file: str | None = None) -> tuple[int, int]:
    """(start row, rows) of one row group; RangeError where there is none, or more than one in different files and no ``file`` says which."""
    found = index.where(F.col(RG) == group)
    rows = (found if file is None else found.where(F.col(FILE) == file)).select("start_row", "num_rows").take(2)
    if len(rows) != 1:
        raise RangeError(f"row group {group} is in several files" if rows else f"no row group {group}")
    return rows[0][0], rows[0][1]


def project(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order; unknown ones are passed over."""
    return df.select(*[c for c in wanted if c in df.columns])


def read_chunk(df: DataFrame, group: int, column: str, file: str | None = None) -> DataFrame:
    """Point read: (file, ord, column) of one row group; without ``file`` that group of every file. Unknown columns and negative groups are refused."""
    if column not in df.columns:
        raise KeyError(column)
    if group < 0:
        raise RangeError(f"no row group {group}")
    found = df.where(F.col(RG) == group)
    return (found if file is None else found.where(F.col(FILE) == file)).select(*group_keys(df)[:-1], ORD, column)


def skip(df: DataFrame, n: int, rows: int | None = None) -> DataFrame:
    """Rows from position n of each row group on; with ``rows`` (of the group) given, n must lie within."""
    if n < 0 or rows is not None and n >= rows:
        raise RangeError(f"can't skip {n} of {rows} rows")
    return df.where(F.col(POS) >= n)


def skip_positions(skips: list[int], rows: int) -> list[int]:
    """Positions that a reader standing on row 0 reaches by skips one after another."""
    at, out = 0, []
    for s in skips:
        if s < 0:
            raise RangeError(f"can't skip {s} rows")
        if at + s >= rows:
            raise IndexError(f"row {at + s} is beyond the last of {rows}")
        at += s
        out.append(at)
    return out


def iterate(df: DataFrame, column: str) -> DataFrame:
    """Null-aware values of a column: (file, ord, is_null, value)."""
    return df.select(*[FILE] * (FILE in df.columns), ORD, F.col(column).isNull().alias("is_null"), F.col(column).alias("value"))


def null_counts(df: DataFrame, column: str) -> DataFrame:
    """(file, rg, num_values, num_nulls) of a column's chunks."""
    return df.groupBy(*group_keys(df)).agg(F.count(column).alias("num_values"), F.count_if(F.col(column).isNull()).alias("num_nulls"))
