"""File footers as relations: files, row groups, column chunks, key/value pairs.

``footers`` lists files through Spark (any store that Spark reads) and parses each footer in a task. Two ranged reads per file, its tail and its head,
are enough; where Arrow doesn't know a store's scheme, the file's bytes come through Spark's ``binaryFile`` scan instead.
``FooterSource`` and ``RowGroupSource`` offer the same as data sources for ``spark.read.format``; a point read touches only the row groups and
columns it names, and types that Spark's own scan refuses are read too. ``read_row_groups`` is the same for any number of files.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions.paths import uri
from ..functions.shipping import ship
from .stores import KNOWN_SCHEMES, file_system, opened, read_range, scheme
from .thrift import read_struct

MAGIC = b"PAR1"
#: Bytes read from a file's end at first; a longer footer takes a second read.
TAIL_BYTES = 64 * 1024
#: Most tasks that open files; files (or row groups) of one task, and bytes that it reads, where there are more than a few tasks for each core.
TASKS, TASK_FILES, TASK_BYTES = 10_000, 256, 128 << 20
#: Rows of a relation that a task hands on at a time.
BATCH_ROWS = 2_000

RELATIONS = {
    "files": "path string, length long, footer_offset long, footer_length long, version long, created_by string, num_rows long, num_row_groups long, num_columns long",
    "row_groups": "path string, row_group long, start_row long, num_rows long, total_bytes long, compressed_bytes long",
    "column_chunks": "path string, row_group long, col long, column string, physical string, logical string, codec string, num_values long, encodings array<string>, has_dictionary boolean, dictionary_offset long, data_offset long, start long, length long",
    "kv": "path string, pos long, key string, value string",
    # Footers in thrift's bytes, for files written anew: ``head`` is the footer without row groups, ``entry`` that of a row group or chunk.
    "group_entries": "path string, row_group long, start long, length long, num_rows long, data_end long, head binary, entry binary",
    "chunk_entries": "path string, row_group long, column string, start long, length long, num_values long, num_rows long, entry binary",
    "schemas": "path string, schema binary",
}


class FooterError(ValueError):
    """Bytes that aren't a Parquet file's, or a file without what was asked for."""


def parse_footer(length: int, read: Callable[[int, int], bytes]) -> tuple[bytes, int]:
    """(footer bytes, its offset); ``read(start, n)`` gives bytes of the file. Magic is checked at both ends."""
    if length < 12:
        raise FooterError(f"{length} bytes are too few for a Parquet file")
    tail = read(max(0, length - TAIL_BYTES), min(length, TAIL_BYTES))
    if tail[-4:] != MAGIC or read(0, 4) != MAGIC:
        raise FooterError("no Parquet magic at both ends")
    size = struct.unpack("<I", tail[-8:-4])[0]
    start = length - 8 - size
    if start < 4:
        raise FooterError(f"a footer of {size} bytes doesn't fit a file of {length}")
    return (tail[-8 - size : -8] if size + 8 <= len(tail) else read(start, size)), start


def chunk_start(dictionary_offset: int | None, data_offset: int) -> int:
    """First byte of a chunk: its dictionary page if that lies before the data, else the first data page."""
    start = dictionary_offset if dictionary_offset and 0 < dictionary_offset < data_offset else data_offset
    if start < len(MAGIC):
        raise FooterError(f"a chunk can't start at {start}")
    return start


def rows_of(path: str, length: int, read: Callable[[int, int], bytes], relation: str) -> Iterator[tuple]:
    """Rows of one relation for one file."""
    import pyarrow.parquet as pq

    raw, offset = parse_footer(length, read)
    if relation == "kv":
        for i, pair in enumerate(read_struct(raw)[0].get(5, [])):
            value = pair.get(2)
            yield path, i, pair[1].decode("utf-8", "replace"), None if value is None else value.decode("utf-8", "replace")
        return
    if relation in ("group_entries", "chunk_entries", "schemas"):
        from .chunks import entries_of

        yield from entries_of(path, raw, offset, relation)
        return
    whole = MAGIC + raw + struct.pack("<I", len(raw)) + MAGIC
    meta = pq.read_metadata(pa.BufferReader(whole))
    if relation == "files":
        version = read_struct(raw)[0].get(1)
        yield path, length, offset, len(raw), version, meta.created_by, meta.num_rows, meta.num_row_groups, meta.num_columns
        return
    start_row = 0
    for i in range(meta.num_row_groups):
        g = meta.row_group(i)
        chunks = [g.column(j) for j in range(g.num_columns)]
        if relation == "row_groups":
            yield path, i, start_row, g.num_rows, g.total_byte_size, sum(c.total_compressed_size for c in chunks)
            start_row += g.num_rows
            continue
        for j, c in enumerate(chunks):
            logical = meta.schema.column(j).logical_type
            dictionary = c.dictionary_page_offset if c.has_dictionary_page else None
            yield (
                path, i, j, c.path_in_schema, c.physical_type, None if logical.type == "NONE" else str(logical), c.compression, c.num_values, list(c.encodings),
                c.has_dictionary_page, dictionary, c.data_page_offset, chunk_start(dictionary, c.data_page_offset), c.total_compressed_size,
            )


def _read_at(f) -> Callable[[int, int], bytes]:
    return lambda start, n: f.read_at(n, start)


def _data_file(path: Column) -> Column:
    """Whether a name isn't that of an unfinished or hidden file; Spark's listing passes over such folders itself."""
    return ~path.rlike(r"/[_.][^/]*$")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files of a table, whatever the store; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(_data_file(F.col("path")))


def tasks_for(spark: SparkSession, count: int, size: int = 0) -> int:
    """Tasks for ``count`` files or ranges of ``size`` bytes: one each while there are few for the session's cores, else up to ``TASK_FILES`` and ``TASK_BYTES`` in one."""
    wanted = max(4 * spark.sparkContext.defaultParallelism, -(-count // TASK_FILES), -(-size // TASK_BYTES))
    return max(1, min(count, wanted, TASKS))


def dealt(files: DataFrame, size: str | None = None) -> DataFrame:
    """A relation of files or ranges (of ``size`` bytes, a column) dealt out to tasks."""
    count, held = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(0)).first()
    return files.repartition(tasks_for(files.sparkSession, count, held))


def footers(spark: SparkSession, path: str, relation: str = "files", *, files: DataFrame | None = None) -> DataFrame:
    """One of ``RELATIONS`` for every file under ``path``, or for the files that a relation (path) names."""
    if relation not in RELATIONS:
        raise FooterError(f"no relation {relation}: one of {', '.join(RELATIONS)}")
    ship(spark)
    schema = RELATIONS[relation]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                content = row.get("content")
                if content is not None:
                    yield from rows_of(row["path"], len(content), lambda a, n, c=content: c[a : a + n], relation)
                else:
                    with opened(row["path"]) as f:
                        yield from rows_of(row["path"], f.size(), _read_at(f), relation)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in some], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    if files is not None:
        files = dealt(files.select("path"))
    elif scheme(path) in KNOWN_SCHEMES:
        files = dealt(list_files(spark, path).withColumn("path", uri(F.col("path"))))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(_data_file(F.col("path"))).select("path", "length", "content")
    return files.mapInArrow(parsed, schema)


def dictionary_supported(chunks: DataFrame) -> DataFrame:
    """(path, row_group, column, supported): whether a chunk has a dictionary page and dictionary-encoded data."""
    encoded = F.exists("encodings", lambda e: e.isin("RLE_DICTIONARY", "PLAIN_DICTIONARY"))
    return chunks.select("path", "row_group", "column", (F.col("has_dictionary") & encoded).alias("supported"))


def first_values(kv: DataFrame, by: tuple[str, ...] = ("path", "key"), value: str = "value", pos: str = "pos") -> DataFrame:
    """Value of each key: of repeated keys the first by position."""
    return kv.groupBy(*by).agg(F.min_by(value, pos).alias(value))


def custom_metadata(kv: DataFrame, key: str) -> str | None:
    """A key's first value in one file's pairs; None where it is absent."""
    row = first_values(kv.where(F.col("key") == key)).orderBy("path").first()
    return None if row is None else row["value"]


def row_group_starts(row_groups: DataFrame) -> DataFrame:
    """The relation with ``start_row`` computed anew by prefix sums within each file."""
    before = Window.partitionBy("path").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1)
    return row_groups.withColumn("start_row", F.coalesce(F.sum("num_rows").over(before), F.lit(0)).cast("long"))


def column_chunk(chunks: DataFrame, row_group: int, column: str) -> DataFrame:
    """Metadata of one chunk; a row group or column that isn't there is an error."""
    found = chunks.where((F.col("row_group") == row_group) & (F.col("column") == column))
    if found.isEmpty():
        raise FooterError(f"no chunk of column {column} in row group {row_group}")
    return found


def bytes_of_ranges(ranges: DataFrame) -> DataFrame:
    """``ranges`` (path, start, n and other columns) with their ``bytes``, by ranged reads in tasks; only the ranges asked for are read.

    A range beyond the end is an error; one range is at most a cell of 2 GB, the file may be of any size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*ranges.schema.fields, StructField("bytes", BinaryType())])
    arrow = to_arrow_schema(schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([row | {"bytes": read_range(row["path"], row["start"], row["n"])}], schema=arrow)

    ship(ranges.sparkSession)
    return dealt(ranges, "n").mapInArrow(fetch, schema)


def byte_ranges(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Bytes of ranges (start, n) of every file: (path, start, n, bytes). A negative start counts from the end (the last n bytes)."""
    asked = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(n).cast("long").alias("n")) for a, n in ranges])
    files = list_files(spark, path).select(uri(F.col("path")).alias("path"), "length", F.explode(asked).alias("r"))
    start = F.when(F.col("r.start") < 0, F.col("length") + F.col("r.start")).otherwise(F.col("r.start"))
    return bytes_of_ranges(files.select("path", start.alias("start"), F.col("r.n").alias("n")))


class _File(InputPartition):
    def __init__(self, path: str, row_group: int | None = None):
        self.path, self.row_group = path, row_group


def _files_under(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FooterError(f"no such path: {path}")
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = "" if scheme(path) in ("", "file") else f"{scheme(path)}://"
    hidden = re.compile(r"/[_.][^/=]*(/|$)")
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not hidden.search(f.path[len(inner) :]))


class FooterSource(DataSource):
    """``spark.read.format("rowgrove_footers").option("relation", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "rowgrove_footers"

    def schema(self) -> str:
        return RELATIONS[self.options.get("relation", "files")]

    def reader(self, schema) -> DataSourceReader:
        return _FooterReader(self.options)


class _FooterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.relation = options["path"], options.get("relation", "files")

    def partitions(self):
        return [_File(p) for p in _files_under(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with opened(partition.path) as f:
            yield from rows_of(partition.path, f.size(), _read_at(f), self.relation)


def _arrow_schema(path: str) -> pa.Schema:
    import pyarrow.parquet as pq

    with opened(_files_under(path)[0]) as f:
        return pq.ParquetFile(f).schema_arrow


def _plain(field: pa.Field) -> pa.Field:
    """The nearest type that Spark has: binary(2) for half floats, binary(16) for UUIDs, long for times and nanoseconds."""
    t = field.type
    if isinstance(t, pa.BaseExtensionType):
        t = t.storage_type
    if pa.types.is_float16(t) or pa.types.is_fixed_size_binary(t):
        return pa.field(field.name, pa.binary())
    if pa.types.is_time(t) or pa.types.is_timestamp(t) and t.unit == "ns":
        return pa.field(field.name, pa.int64())
    return pa.field(field.name, t)


def _cast(column: pa.ChunkedArray, to: pa.DataType) -> pa.ChunkedArray:
    t = column.type
    if isinstance(t, pa.BaseExtensionType):
        column = pa.chunked_array([c.storage for c in column.chunks], t.storage_type)
        t = column.type
    if pa.types.is_float16(t):
        raw = [None if v is None else struct.pack("<e", float(v)) for v in column.to_pylist()]
        return pa.chunked_array([pa.array(raw, pa.binary())])
    if pa.types.is_time32(t):
        return column.cast(pa.int32()).cast(pa.int64())
    return column.cast(to)


def _group_batches(path: str, groups: list[int] | None, fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Rows of row groups of one file (all of them, or those of ``groups`` that it has), with file, rg and ord."""
    import pyarrow.parquet as pq

    with opened(path) as f:
        read = pq.ParquetFile(f)
        start = 0
        for i in range(read.metadata.num_row_groups):
            n = read.metadata.row_group(i).num_rows
            if groups is None or i in groups:
                at = start
                for b in read.iter_batches(65_536, row_groups=[i], columns=[x.name for x in fields]):
                    t = pa.table(b) if not isinstance(b, pa.Table) else b
                    columns = [pa.array([path] * len(t), pa.string()), pa.array([i] * len(t), pa.int64()), pa.array(range(at, at + len(t)), pa.int64())]
                    columns += [_cast(t.column(x.name), x.type) for x in fields]
                    at += len(t)
                    yield from pa.table(columns, names=["file", "rg", "ord", *[x.name for x in fields]]).combine_chunks().to_batches()
            start += n


class RowGroupSource(DataSource):
    """``spark.read.format("rowgrove_row_groups").option("row_groups", "0,2").option("columns", "a,b").load(path)``

    Adds ``file``, ``rg`` and ``ord``; without the options all row groups and columns are read. There is a partition for each file, or for each file and
    row group that is asked for; footers are opened in tasks. A file without such a group adds nothing; if no file has it, there are no rows.
    The list of files is made on the driver: for very many files use ``read_row_groups``.
    """

    @classmethod
    def name(cls) -> str:
        return "rowgrove_row_groups"

    def _fields(self) -> list[pa.Field]:
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        schema = _arrow_schema(self.options["path"])
        if missing := [c for c in wanted if c not in schema.names]:
            raise FooterError(f"no such columns: {', '.join(missing)}")
        return [_plain(schema.field(c)) for c in (wanted or schema.names)]

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_with_position(self._fields()))

    def reader(self, schema) -> DataSourceReader:
        groups = self.options.get("row_groups", "")
        return _RowGroupReader(self.options["path"], [int(g) for g in groups.split(",") if g], self._fields())


def _with_position(fields: list[pa.Field]) -> pa.Schema:
    return pa.schema([pa.field("file", pa.string()), pa.field("rg", pa.int64()), pa.field("ord", pa.int64()), *fields])


class _RowGroupReader(DataSourceReader):
    def __init__(self, path: str, groups: list[int], fields: list[pa.Field]):
        self.path, self.groups, self.fields = path, groups, fields

    def partitions(self):
        return [_File(path, i) for path in _files_under(self.path) for i in (self.groups or [None])]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from _group_batches(partition.path, None if partition.row_group is None else [partition.row_group], self.fields)


def read_row_groups(spark: SparkSession, groups: DataFrame, columns: list[str], like: str) -> DataFrame:
    """Rows (file, rg, ord, columns) of row groups (path, row_group), dealt out to tasks; ``like`` is a file with the schema.

    ``groups`` is the footer relation or a part of it; no list of files or groups goes to the driver.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = _arrow_schema(like)
    if missing := [c for c in columns if c not in schema.names]:
        raise FooterError(f"no such columns: {', '.join(missing)}")
    fields = [_plain(schema.field(c)) for c in columns]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _group_batches(row["path"], [row["row_group"]], fields)

    ship(spark)
    sized = "compressed_bytes" if "compressed_bytes" in groups.columns else None
    return dealt(groups, sized).select("path", "row_group").mapInArrow(fetch, from_arrow_schema(_with_position(fields)))


def register(spark: SparkSession) -> None:
    """Make both data sources known to the session."""
    ship(spark)
    for source in (FooterSource, RowGroupSource):
        spark.dataSource.register(source)
