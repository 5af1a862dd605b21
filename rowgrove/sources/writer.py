"""Sinks: Parquet with chosen row groups, codecs, pages, dictionaries and key/value metadata."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import delete_folder, exists, scratch
from ..functions.schema import SchemaError, require, same_columns, validate_flat_schema
from ..functions.shipping import ship
from . import chunks, footer
from .stores import KNOWN_SCHEMES, Upload, file_system, read_range, scheme


class WriterError(ValueError):
    """A file, row group or column written otherwise than declared."""


CODECS = {"none": "uncompressed", "uncompressed": "uncompressed", "snappy": "snappy", "zstd": "zstd"}
ZSTD_LEVEL = 2
#: Rows that one task sorts for a file; most pieces of one file, whose data and page indexes are a part of an upload each.
PIECE_ROWS, MOST_PIECES = 1 << 19, 4_900
#: Most bytes of a file that is one cell of a DataFrame.
CELL_BYTES = (1 << 31) - 1024


def write_options(*, codec: str = "zstd", level: int | None = None, rows_per_group: int | None = None, dictionary: bool | None = None, dictionary_bytes: int | None = None, page_rows: int | None = None, page_bytes: int | None = None, version: int = 1) -> dict[str, str]:
    """Options of Spark's Parquet writer for a layout."""
    if codec not in CODECS:
        raise SchemaError(f"codec {codec}: one of {', '.join(CODECS)}")
    out = {"compression": CODECS[codec], "parquet.writer.version": "PARQUET_2_0" if version == 2 else "PARQUET_1_0"}
    if codec == "zstd":
        out["parquet.compression.codec.zstd.level"] = str(ZSTD_LEVEL if level is None else level)
    for key, value in (
        ("parquet.block.row.count.limit", rows_per_group), ("parquet.enable.dictionary", None if dictionary is None else str(dictionary).lower()),
        ("parquet.dictionary.page.size", dictionary_bytes), ("parquet.page.row.count.limit", page_rows), ("parquet.page.size", page_bytes),
    ):
        if value is not None:
            out[key] = str(value)
    return out


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite", **layout) -> None:
    """Write a flat table; see ``write_options`` for the layout."""
    validate_flat_schema(df.schema)
    require(df, df.schema)
    df.write.mode(mode).options(**write_options(**layout)).parquet(path)


def write_row_groups(df: DataFrame, path: str, rows_per_group: int, *, order: Sequence[str] = (), declared_rows: int | None = None, columns: Sequence[str] | None = None, mode: str = "overwrite", **layout) -> None:
    """Write one file with row groups of exactly ``rows_per_group`` rows (the last may have fewer), rows by ``order``.

    Up to ``PIECE_ROWS`` rows, or without an order, a single task writes it. Beyond, tasks sort and write pieces of whole row groups, and the pieces' bytes are
    put together to the one file, undecoded, under a new footer: no task sorts more than a piece.
    """
    validate_flat_schema(df.schema)
    if columns is not None:
        same_columns(df.columns, columns)
        df = df.select(*columns)
    n = df.count()
    if not n:
        raise SchemaError("a file without row groups can't be written")
    if declared_rows is not None and n != declared_rows:
        raise SchemaError(f"{n} rows, not the declared {declared_rows}")
    options = write_options(rows_per_group=rows_per_group, **layout)
    if order and n > max(PIECE_ROWS, rows_per_group) and scheme(path) in KNOWN_SCHEMES:
        _write_pieces(df, path, rows_per_group, n, list(order), mode, options)
        return
    one = df.repartition(1)
    one = one.sortWithinPartitions(*order) if order else one
    one.write.mode(mode).options(**options).parquet(path)


def _write_pieces(df: DataFrame, path: str, rows_per_group: int, n: int, order: list[str], mode: str, options: dict[str, str]) -> None:
    spark = df.sparkSession
    if exists(spark, path) and mode in ("errorifexists", "error", "ignore"):
        if mode == "ignore":
            return
        raise SchemaError(f"{path} already exists")
    rows = -(-max(PIECE_ROWS, -(-n // MOST_PIECES)) // rows_per_group) * rows_per_group
    count = -(-n // rows)
    work = scratch(spark, "pieces")
    try:
        dealt, by = _dealt_rows(df, order, rows, n, f"{work}/numbered")
        # Piece k is task k's: rows are dealt by the number itself, not by its hash.
        dealt = dealt.repartitionById(count, F.col("_piece").cast("int")).sortWithinPartitions("_piece", *by)
        dealt.select("_piece", *df.columns).write.partitionBy("_piece").options(**options).parquet(f"{work}/written")
        if mode == "overwrite":
            delete_folder(spark, path)
        _join_pieces(spark, f"{work}/written", f"{path}/part-00000-{uuid.uuid4()}.parquet")
    finally:
        delete_folder(spark, work)


def _dealt_rows(df: DataFrame, order: list[str], rows: int, n: int, numbered: str) -> tuple[DataFrame, list[str]]:
    """Rows with their piece of ``rows`` rows in sorted order, and the columns that sort a piece.

    Where one whole number per row (an ordinal) says the piece, which is checked by counting, that is it; else rows are sorted in ranges, written and numbered.
    """
    if len(order) == 1 and df.schema[order[0]].dataType.typeName() in ("byte", "short", "integer", "long"):
        piece = F.floor(F.col(order[0]) / rows)
        found = df.groupBy(piece.alias("p")).count().orderBy("p").limit(-(-n // rows) + 1).collect()
        if [(r["p"], r["count"]) for r in found] == [(i, min(rows, n - i * rows)) for i in range(-(-n // rows))]:
            return df.withColumn("_piece", piece), order
    spark = df.sparkSession
    mixed = df.withColumn("_tie", F.xxhash64(*df.columns))
    ranged = mixed.repartitionByRange(-(-n // rows), *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # The id holds the task's number in its upper bits and the row's place in it in the lower 33.
    ranged.withColumn("_id", F.monotonically_increasing_id()).write.parquet(numbered)
    read = spark.read.schema(ranged.withColumn("_id", F.lit(0).cast("long")).schema).parquet(numbered)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = read.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each task
    met = read.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.withColumn("_piece", F.floor((F.col("_start") + place) / rows)), ["_id"]


def _join_pieces(spark, written: str, target: str) -> None:
    """One file of the row groups of files (``_piece=k``), their bytes and page indexes copied by a task for each; the driver holds the new footer."""
    piece = F.regexp_extract("path", r"_piece=(\d+)", 1).cast("long")
    sized = footer.footers(spark, written, "group_entries").groupBy(piece.alias("piece"), "path").agg((F.max(F.col("start") + F.col("length")) - len(chunks.MAGIC)).alias("size"))
    rows, at = [], len(chunks.MAGIC)
    for r in sorted(sized.collect(), key=lambda r: r["piece"]):  # a row for each piece
        rows.append((r["piece"], r["path"], at, r["size"]))
        at += r["size"]
    last = len(rows)
    with Upload(target) as upload:
        name = upload.id

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    part = Upload(target, upload=name)
                    data = read_range(r["path"], len(chunks.MAGIC), r["size"])
                    part.put_part(r["piece"] + 1, chunks.MAGIC + data if r["piece"] == 0 else data)
                    del data
                    groups, index, count = chunks.moved_groups(r["path"], r["start"] - len(chunks.MAGIC))
                    part.put_part(last + r["piece"] + 1, index)
                    yield pa.RecordBatch.from_pylist([{"piece": r["piece"], "rows": count, "index": len(index), "groups": groups}], schema=out)

        out = pa.schema([("piece", pa.int64()), ("rows", pa.int64()), ("index", pa.int64()), ("groups", pa.list_(pa.binary()))])
        given = spark.createDataFrame(rows, "piece long, path string, start long, size long").repartitionById(last, F.col("piece").cast("int"))
        done = given.mapInArrow(put, "piece long, rows long, `index` long, groups array<binary>").collect()  # footer entries of one file; sorted here, as Spark's sort would run the tasks twice
        made = []
        for r in sorted(done, key=lambda r: r["piece"]):
            for group in r["groups"]:
                made.append(chunks.placed_group(bytes(group), at, len(made)))
            at += r["index"]
        upload.known(range(1, 2 * last + 1)).put_part(2 * last + 1, chunks.footer_bytes(chunks.file_head(rows[0][1]), made, rows=sum(r["rows"] for r in done)))
        upload.finish()


def write_grouped_files(df: DataFrame, path: str, rows_per_group: int, rows_per_file: int, *, ordinal: str = "ord", mode: str = "overwrite", **layout) -> None:
    """Write many files in parallel: ordinals are dealt by file, and each file has row groups of exactly ``rows_per_group`` rows."""
    validate_flat_schema(df.schema)
    if rows_per_file % rows_per_group:
        raise SchemaError("a file holds whole row groups")
    dealt = df.withColumn("_file", F.floor(F.col(ordinal) / rows_per_file)).repartition("_file").sortWithinPartitions("_file", ordinal)
    dealt.write.mode(mode).partitionBy("_file").options(**write_options(rows_per_group=rows_per_group, **layout)).parquet(path)


class ValueWriter:
    """One column's values, one after another; ``finish`` closes it and gives them as an Arrow column."""

    def __init__(self, field: pa.Field, batch: int = 65_536):
        self.field, self.batch, self.held, self.done, self.closed = field, batch, [], [], False

    def write(self, value) -> ValueWriter:
        if self.closed:
            raise WriterError(f"column {self.field.name} is finished")
        if value is None and not self.field.nullable:
            raise WriterError(f"column {self.field.name} takes no nulls")
        self.held.append(value)
        if len(self.held) >= self.batch:
            self._flush()
        return self

    def write_null(self) -> ValueWriter:
        return self.write(None)

    def _flush(self) -> None:
        self.done.append(pa.array(self.held, self.field.type))
        self.held = []

    def finish(self) -> pa.ChunkedArray:
        if self.closed:
            raise WriterError(f"column {self.field.name} is finished")
        if not self.held and not self.done:
            raise WriterError(f"column {self.field.name} has no values")
        if self.held:
            self._flush()
        self.closed = True
        return pa.chunked_array(self.done, self.field.type)


class GroupWriter:
    """The open row group of a file: every column once, in any order, each with the declared number of rows."""

    def __init__(self, schema: pa.Schema, rows: int):
        self.schema, self.rows, self.columns, self.closed = schema, rows, {}, False

    def column(self, name: str) -> ValueWriter:
        """A writer of single values; hand what it has finished to ``write``."""
        return ValueWriter(self.schema.field(name))

    def write(self, name: str, values) -> GroupWriter:
        if self.closed:
            raise WriterError("the row group is finished")
        if name not in self.schema.names:
            raise WriterError(f"no column {name}")
        if name in self.columns:
            raise WriterError(f"column {name} was written already")
        if isinstance(values, ValueWriter):
            values = values.finish()
        if not isinstance(values, (pa.Array, pa.ChunkedArray)):
            values = pa.array(values, self.schema.field(name).type)
        if len(values) != self.rows:
            raise WriterError(f"column {name} has {len(values)} values, not the declared {self.rows}")
        self.columns[name] = values
        return self

    def table(self) -> pa.Table:
        if missing := [c for c in self.schema.names if c not in self.columns]:
            raise WriterError(f"columns are missing: {', '.join(missing)}")
        self.closed = True
        return pa.table([self.columns[c] for c in self.schema.names], schema=self.schema)


class OpenWriter:
    """A file written row group by row group to a stream; one group is open at a time and one is held at a time.

    Each group is exactly what was declared. Key/value pairs can be added until ``finish``, repeated keys are kept; a file without groups is refused.
    """

    def __init__(self, sink, schema: pa.Schema, *, codec: str = "zstd", **options):
        self.schema, self.sink, self.rows, self.open, self.pairs = schema, sink, 0, None, []
        self.options = options | {"compression": "NONE" if codec in ("none", "uncompressed") else codec}
        self.footer, self.entries, self.at, self.closed = None, [], len(chunks.MAGIC), False
        sink.write(chunks.MAGIC)

    @property
    def groups(self) -> int:
        return len(self.entries)

    def start_row_group(self, rows: int) -> GroupWriter:
        self._require_open()
        if self.open is not None:
            raise WriterError("a row group is open already")
        if rows < 1:
            raise WriterError("a row group has at least one row")
        self.open = GroupWriter(self.schema, rows)
        return self.open

    @property
    def current(self) -> GroupWriter:
        if self.open is None:
            raise WriterError("no row group is open")
        return self.open

    def finish_row_group(self) -> None:
        table = self.current.table()
        base, made = chunks.encoded(table, **self.options)
        self.footer = self.footer or base
        self.entries.append(chunks.group_entry(made, self.at, self.groups))
        for c in made:
            self.sink.write(c.read())
            self.at += c.length
        self.rows, self.open = self.rows + table.num_rows, None

    def write_row_group(self, table: pa.Table) -> None:
        group = self.start_row_group(table.num_rows)
        for c in table.column_names:
            group.write(c, table[c])
        self.finish_row_group()

    def add(self, key: str, value: str) -> None:
        self._require_open()
        self.pairs.append((key, value))

    def finish(self) -> None:
        self._require_open()
        if self.open is not None:
            raise WriterError("a row group is still open")
        if not self.groups:
            raise WriterError("a file without row groups can't be written")
        self.sink.write(chunks.footer_bytes(self.footer, self.entries, pairs=[*chunks.pairs_of(self.footer), *self.pairs]))
        self.closed = True

    def _require_open(self) -> None:
        if self.closed:
            raise WriterError("the file is finished")


def assemble_bytes(df: DataFrame, group: str, order: str, *, by: str | None = None, codec: str = "zstd", kv: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Files assembled in memory: a row (num_rows, num_row_groups, length, content) for each value of ``by``, with a row group for each value of ``group``.

    Without ``by`` it is one file. Files are dealt to tasks by ``by`` and arrive sorted by (by, group, order), so a task holds one file's bytes and one row
    group; a file is a cell, so one beyond 2 GB is an error (``write_grouped_files`` and ``split.assemble_files`` have no such bound). ``by`` isn't written.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = writer = file_key = group_key = None
        held: list[pa.RecordBatch] = []

        def close_group() -> None:
            if held:
                writer.write_row_group(pa.Table.from_batches(held))
                held.clear()
                if sink.tell() > CELL_BYTES:
                    raise WriterError(f"a file assembled in memory is over {CELL_BYTES} bytes")

        def close_file() -> pa.RecordBatch:
            close_group()
            writer.finish()
            content = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_pylist([{"num_rows": writer.rows, "num_row_groups": writer.groups, "length": len(content), "content": content}], schema=out)

        for batch in batches:
            files = batch.column(batch.schema.get_field_index(by)).to_pylist() if by else [None] * batch.num_rows
            groups = batch.column(batch.schema.get_field_index(group)).to_pylist()
            kept = batch.select([c for c in batch.schema.names if c != by])
            keys = list(zip(files, groups, strict=True))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True) if keys else ():
                if writer is not None and files[a] != file_key:
                    yield close_file()
                    writer = None
                if writer is None:
                    sink, file_key, group_key = pa.BufferOutputStream(), files[a], groups[a]
                    writer = OpenWriter(sink, kept.schema, codec=codec)
                    for k, v in kv:
                        writer.add(k, v)
                if groups[a] != group_key:
                    close_group()
                    group_key = groups[a]
                held.append(kept.slice(a, b - a))
        if writer is not None:
            yield close_file()

    out = pa.schema([("num_rows", pa.int64()), ("num_row_groups", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])
    validate_flat_schema(df.schema)
    ship(df.sparkSession)
    ready = df.repartition(by).sortWithinPartitions(by, group, order) if by else df.repartition(1).sortWithinPartitions(group, order)
    return ready.mapInArrow(build, "num_rows long, num_row_groups long, length long, content binary")


def store_bytes(files: DataFrame, path: str) -> int:
    """Write assembled files (content) as files of ``path``, each in the task that has it; returns how many. The folder is a new one."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['n']:011d}.parquet"
                with system.open_output_stream(written := f"{folder}/.{name}-{uuid.uuid4().hex}") as f:
                    f.write(row["content"])
                system.move(written, f"{folder}/{name}")
                yield pa.RecordBatch.from_pylist([{"n": row["n"]}], schema=pa.schema([("n", pa.int64())]))

    ship(files.sparkSession)
    return files.select(F.monotonically_increasing_id().alias("n"), "content").mapInArrow(put, "n long").count()
