"""Assembly of tables from row groups and columns of other tables: append, reorder, widen, narrow, recompress.

A source is a DataFrame with ``ord`` (and ``rg`` where groups matter). Orders are carried as columns; rows are sorted only when written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.schema import SchemaError, same_columns
from ..functions.sizes import MAGIC_BYTES, plain_bytes
from ..functions.paths import reliable
from .ordinals import FILE, ORD, RG, few, group_keys, number_groups, table_ordinals


class AssemblyError(ValueError):
    """Sources that don't fit together."""


def append(sources: Sequence[DataFrame], *, rows: Sequence[int] | None = None) -> DataFrame:
    """Rows of all sources, which have the same columns, with ``source_no`` and a new ordinal over all of them.

    The new ordinal is the source's own plus the rows before it, so nothing is sorted; ``rows`` gives counts that are known already. A source of several
    files (``file``) is numbered through first (``ordinals.table_ordinals``). Row groups (``rg``) stay those of their source.
    """
    if not sources:
        raise AssemblyError("no sources")
    for s in sources[1:]:
        same_columns(s.columns, sources[0].columns)
    if rows is None:
        rows = [s.count() for s in sources]
    sources = [table_ordinals(s) for s in sources]
    before = [sum(rows[:i]) for i in range(len(rows))]
    parts = [s.withColumns({"source_no": F.lit(i).cast("long"), ORD: (F.col(ORD) + F.lit(b)).cast("long")}) for i, (s, b) in enumerate(zip(sources, before, strict=True))]
    return reduce(DataFrame.unionByName, parts)


def reorder(df: DataFrame, index: DataFrame, new_order: DataFrame | None = None) -> DataFrame:
    """Row groups in a new order, with ``new_ord``; ``new_order`` is (file, rg, new_position), by default the reverse of the order of file and rg.

    ``index`` is (file, rg, start_row, num_rows): new ordinals are prefix sums over row groups plus positions, not a sort of rows. Groups are named
    by ``file`` too wherever rows have one.
    """
    keys = group_keys(df)
    if group_keys(index) != keys:
        raise AssemblyError(f"rows are grouped by {', '.join(keys)}, the index by {', '.join(group_keys(index))}")
    if new_order is None:
        new_order = number_groups(index).select(*keys, (-F.col("group_no")).alias("new_position"))
    before = Window.orderBy("new_position").rowsBetween(Window.unboundedPreceding, -1)  # over row groups, not rows
    placed = index.join(new_order, keys).withColumn("new_start", F.coalesce(F.sum("num_rows").over(before), F.lit(0)))
    placed = few(placed.select(*keys, F.col("start_row").alias("_start"), "new_start"))
    return df.join(placed, keys).withColumn("new_ord", (F.col("new_start") + F.col(ORD) - F.col("_start")).cast("long")).drop("_start", "new_start")


def checked_groups(df: DataFrame) -> DataFrame:
    """The index of row groups (with group_no) of a source whose ordinals occur once in each group; an AssemblyError otherwise.

    Ordinals are counted by bitmaps, which are combined before the shuffle.
    """
    keys = group_keys(df)
    bits = df.groupBy(*keys, F.bitmap_bucket_number(ORD).alias("_bucket")).agg(
        F.count("*").alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(ORD))).alias("distinct"), F.min(ORD).alias("first")
    )
    found = reliable(bits.groupBy(*keys).agg(F.sum("n").alias("num_rows"), F.sum("distinct").alias("distinct"), F.min("first").alias("start_row")))
    twice = found.where("num_rows <> distinct").orderBy(*keys).first()
    if twice is not None:
        raise AssemblyError(f"row group {twice[RG]}: {twice['num_rows']} rows have {twice['distinct']} ordinals")
    return number_groups(found.drop("distinct"))


def add_column(base: DataFrame, extra: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of another source put beside ``base``: the k-th row group of all its files meets the k-th of the other's, row by row.

    Row groups must have equal row counts in both. Where a source has no ``file``, its groups are named by rg alone, and repeated ordinals are refused.
    """
    if twice := [c for c in columns if c in base.columns]:
        raise AssemblyError(f"columns are there already: {', '.join(twice)}")
    a, b = checked_groups(base), checked_groups(extra)
    same = group_keys(base) == group_keys(extra) == [RG]
    one, two = (x.select(F.col(RG if same else "group_no").alias("no"), F.col("num_rows").alias(n)) for x, n in ((a, "n"), (b, "m")))
    unlike = one.join(two, "no", "full").where("n IS DISTINCT FROM m").orderBy("no").first()
    if unlike is not None:
        raise AssemblyError(f"row group {unlike['no']}: {unlike['n']} rows and {unlike['m']} rows")
    if same:
        return base.join(extra.select(RG, ORD, *columns), [RG, ORD])

    def placed(df: DataFrame, index: DataFrame) -> DataFrame:
        index = few(index.select(*group_keys(index), F.col("group_no").alias("_no"), F.col("start_row").alias("_start")))
        return df.join(index, group_keys(df)).withColumn("_pos", F.col(ORD) - F.col("_start")).drop("_start")

    return placed(base, a).join(placed(extra, b).select("_no", "_pos", *columns), ["_no", "_pos"]).select(*base.columns, *columns)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen columns in the chosen order; unknown ones are refused."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"no such columns: {', '.join(missing)}")
    return df.select(*columns)


def row_counts(sources: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """(source_no, num_rows, declared, ok) of sources and their declared row counts."""
    parts = [
        s.agg(F.count("*").alias("num_rows")).select(F.lit(i).cast("long").alias("source_no"), "num_rows", F.lit(n).cast("long").alias("declared"))
        for i, (s, n) in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("num_rows") == F.col("declared"))


def chunk_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rg, col, column, num_rows, sz): PLAIN bytes of every chunk, in one aggregate."""
    keys = group_keys(df)
    parts = [F.struct(F.lit(i).cast("long").alias("col"), F.lit(c).alias("column"), F.count("*").alias("num_rows"), plain_bytes(df.schema[c]).alias("sz")) for i, c in enumerate(columns)]
    return df.groupBy(*keys).agg(F.array(*parts).alias("all")).select(*keys, F.inline("all"))


def group_sizes(chunks: DataFrame) -> DataFrame:
    """(rg, num_columns, num_rows, bytes) of every row group."""
    keys = group_keys(chunks)
    return chunks.groupBy(*keys).agg(F.count("*").alias("num_columns"), F.max("num_rows").alias("num_rows"), F.sum("sz").cast("long").alias("bytes"))


def relocate(chunks: DataFrame) -> DataFrame:
    """Offsets of chunks laid one behind another after the leading magic, in order of (rg, col), in each file: start_off added."""
    keys = group_keys(chunks)[:-1]
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(RG, "col").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start_off", (F.coalesce(F.sum("sz").over(order), F.lit(0)) + MAGIC_BYTES).cast("long"))


def copy_chunk(df: DataFrame, group: int, column: str, declared_rows: int | None = None, file: str | None = None) -> DataFrame:
    """Rows (file, ord, column) of one chunk, checked against a declared row count where one is given."""
    found = df.where(F.col(RG) == group)
    chunk = (found if file is None else found.where(F.col(FILE) == file)).select(*group_keys(df)[:-1], ORD, column)
    if declared_rows is not None and (n := chunk.count()) != declared_rows:
        raise AssemblyError(f"the chunk has {n} rows, not {declared_rows}")
    return chunk


def recompress(df: DataFrame, path: str, codec: str, level: int | None = None) -> DataFrame:
    """Write with another codec (none, snappy, zstd) and read again."""
    from ..sources.writer import write_table

    write_table(df, path, codec=codec, level=level)
    return df.sparkSession.read.schema(df.schema).parquet(path)
