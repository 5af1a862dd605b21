"""Registered queries of the table operators: one for each operator (or family) over the whole of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import reliable, scratch, table_path, uri
from ..functions.schema import SchemaError, schema_relation
from ..plans import assemble, dictionary, parts, processors, split
from ..plans import ordinals as o
from ..sources import chunks, footer, stores, thrift, writer

ROWS_PER_GROUP = 4096
CHUNKS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
PART_BYTES = 90_000
PLANNED_PARTS, MIN_PART, BUFFER_BYTES = 5, 20_000, 200_000
FOOTER_BYTES = 1_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations pages benchmark".split()


def _scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with one ordinal over all of a table's files."""
    return o.table_ordinals(o.scan(spark, table_path(sf_dir, name), columns))


def _grouped(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, rows: int = ROWS_PER_GROUP) -> DataFrame:
    return o.logical_groups(_scan(spark, sf_dir, name, columns), rows)


def _text(c: str) -> Column:
    """Chunk values as text that reads the same in every engine."""
    if c == "o_totalprice":
        return F.col(c).cast("decimal(18,2)").cast("string")
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "o_orderdate" else F.col(c).cast("string")


def _optional(column: str, key: str) -> Column:
    return F.when(F.col(key) % 7 != 0, F.col(column))


# Positions and row groups


def row_group_index(spark, d):
    return o.row_group_index(_grouped(spark, d, "orders", ["o_orderkey"])).select("rg", "start_row", "num_rows")


def row_group_totals(spark, d):
    index = o.row_group_index(_grouped(spark, d, "orders", ["o_orderkey"]))
    return index.agg(F.count("*").alias("num_row_groups"), F.sum("num_rows").cast("long").alias("num_rows"), F.max("num_rows").alias("largest"))


def chunk_scan(spark, d):
    columns = ["o_orderstatus", "o_totalprice", "o_orderdate"]
    return processors.scan_chunks(_grouped(spark, d, "orders", columns), columns, _text)


def chunk_scan_summary(spark, d):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return processors.chunk_summary(_grouped(spark, d, "orders", columns), columns, _text)


def row_group_scan_summary(spark, d):
    df = _grouped(spark, d, "events", ["event_type", "value"])
    return df.groupBy("rg").agg(F.count("*").alias("num_rows"), F.countDistinct("event_type").alias("num_types"), F.round(F.sum("value"), 2).alias("sum_value"))


def row_group_processor(spark, d):
    def describe(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rg": [rows["rg"].iloc[0]], "num_rows": [len(rows)], "first_type": [rows["event_type"].iloc[0]], "last_type": [rows["event_type"].iloc[-1]]})

    df = _grouped(spark, d, "events", ["event_type"])
    return processors.process_row_groups(df, describe, "rg long, num_rows long, first_type string, last_type string")


def chunk_processor(spark, d):
    def describe(rg: int, column: str, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rg": [rg], "column": [column], "num_values": [int(values.notna().sum())], "first_value": [values.iloc[0]], "last_value": [values.iloc[-1]]})

    df = _grouped(spark, d, "orders", ["o_orderstatus", "o_orderpriority"])
    return processors.process_chunks(df, ["o_orderstatus", "o_orderpriority"], describe, "rg long, `column` string, num_values long, first_value string, last_value string")


def read_chunk(spark, d):
    return o.read_chunk(_grouped(spark, d, "orders", ["o_totalprice"]), 1, "o_totalprice")


def project_known_columns(spark, d):
    return o.project(spark.read.parquet(table_path(d, "customer")), ["c_name", "no_such_column", "c_custkey", "c_acctbal"])


def project_all(spark, d):
    return spark.read.parquet(table_path(d, "nation")).select("*")


def select_row_groups(spark, d):
    return _grouped(spark, d, "orders", ["o_orderkey"]).where(F.col("rg").isin(0, 2)).select("rg", "ord", "o_orderkey")


def skip_rows(spark, d):
    df = _grouped(spark, d, "orders", ["o_orderkey"]).where("rg = 1")
    return o.skip(df, 1000).select("ord", "pos_in_rg", "o_orderkey")


def skip_relative(spark, d):
    df = _scan(spark, d, "events", ["event_id"])
    reached = o.skip_positions([1, 2, 0, 1], 5)
    steps = spark.createDataFrame([(i + 1, p) for i, p in enumerate(reached)], "step long, ord long")
    return df.where(F.col("ord") <= max(reached)).join(F.broadcast(steps), "ord").select("step", F.col("ord").alias("position"), "event_id")


def null_iteration(spark, d):
    df = _scan(spark, d, "orders", ["o_orderkey", "o_totalprice"]).withColumn("v", _optional("o_totalprice", "o_orderkey"))
    return o.iterate(df, "v")


def null_count_by_chunk(spark, d):
    df = _grouped(spark, d, "orders", ["o_orderkey", "o_totalprice"]).withColumn("v", _optional("o_totalprice", "o_orderkey"))
    return o.null_counts(df, "v")


def global_row_position(spark, d):
    df = _grouped(spark, d, "events", ["event_id"])
    start = F.col("rg") * ROWS_PER_GROUP
    return df.select("rg", "pos_in_rg", start.alias("start_row"), "ord", (start + F.col("pos_in_rg") == F.col("event_id")).alias("matches"))


# Dictionaries


def _priorities(spark, d) -> DataFrame:
    return _grouped(spark, d, "orders", ["o_orderpriority"])


def dictionary_build(spark, d):
    return dictionary.build(_priorities(spark, d), "o_orderpriority").select("rg", "id", "value")


def dictionary_encode(spark, d):
    df = _priorities(spark, d)
    return dictionary.encode(df, "o_orderpriority", dictionary.build(df, "o_orderpriority")).select("rg", "ord", "id")


def dictionary_decode(spark, d):
    df = _priorities(spark, d)
    made = dictionary.build(df, "o_orderpriority")
    return dictionary.decode(dictionary.encode(df, "o_orderpriority", made), made).select("ord", "id", "value")


def dictionary_benefit(spark, d):
    df = _grouped(spark, d, "part", ["p_brand", "p_name"], 512)
    each = [dictionary.benefit(df, c).withColumn("column", F.lit(c)) for c in ("p_brand", "p_name")]
    return each[0].unionByName(each[1])


def dictionary_page_support(spark, d):
    """A column of few values has dictionary pages, one whose values are all different hasn't."""
    to = scratch(spark, "dictionary")
    df = _scan(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    writer.write_row_groups(df.select("ord", "o_orderkey", "o_orderpriority"), to, ROWS_PER_GROUP, order=["ord"], dictionary=True)
    found = footer.dictionary_supported(footer.footers(spark, to, "column_chunks"))
    return found.where("column <> 'ord'").select("row_group", "column", "supported")


def shared_dictionary(spark, d):
    df = _priorities(spark, d)
    return dictionary.encode_shared(df, "o_orderpriority", dictionary.build_shared(df, "o_orderpriority")).select("rg", "ord", "id", "o_orderpriority")


# Key/value metadata


def kv_first_wins(spark, d):
    """Pairs of one file with repeated keys: the nations of a region in their order, of which the first is found."""
    df = _grouped(spark, d, "nation", ["n_nationkey", "n_name"], 10)
    named = spark.read.parquet(table_path(d, "nation")).orderBy("n_nationkey").select("n_regionkey", "n_name").collect()  # as many pairs as a footer holds
    to = scratch(spark, "pairs")
    writer.store_bytes(writer.assemble_bytes(df, "rg", "ord", kv=[(f"region {r.n_regionkey}", r.n_name) for r in named]), to)
    return footer.first_values(footer.footers(spark, to, "kv").where("key LIKE 'region %'")).select("key", "value")


def kv_written(spark, d):
    df = _grouped(spark, d, "nation", ["n_nationkey", "n_name"], 10)
    to = scratch(spark, "kv")
    writer.store_bytes(writer.assemble_bytes(df, "rg", "ord", kv=[("colour", "green"), ("colour", "blue"), ("shape", "round")]), to)
    return footer.footers(spark, to, "kv").where("key IN ('colour', 'shape')").select("key", "value")


# Assembly


def append(spark, d):
    df = _scan(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    half = df.count() // 2
    first, second = df.where(F.col("ord") < half), df.where(F.col("ord") >= half).withColumn("ord", F.col("ord") - half)
    return assemble.append([first, second], rows=[half, half])


def append_three_sources(spark, d):
    df = _scan(spark, d, "nation", ["n_nationkey", "n_name"])
    return assemble.append([df, df, df])


def reorder_row_groups(spark, d):
    df = _grouped(spark, d, "orders", ["o_totalprice"])
    moved = assemble.reorder(df, o.row_group_index(df))
    return moved.select("new_ord", "ord", F.col("o_totalprice").alias("v"))


def add_column(spark, d):
    base = _grouped(spark, d, "orders", ["o_totalprice"]).drop("pos_in_rg")
    extra = _grouped(spark, d, "orders", ["o_custkey"]).withColumn("last_digit", F.col("o_custkey") % 10).drop("pos_in_rg")
    return assemble.add_column(base, extra, ["last_digit"]).select("rg", "ord", "o_totalprice", "last_digit")


def assemble_select_columns(spark, d):
    return assemble.select_columns(spark.read.parquet(table_path(d, "part")), ["p_size", "p_partkey", "p_brand"])


def builder_row_mismatch(spark, d):
    df = spark.read.parquet(table_path(d, "events")).select("event_id", "event_type")
    return assemble.row_counts([(df, 10_000), (df.where("event_id < 100"), 100), (df.where("event_id < 50"), 100)])


def _chunk_sizes(spark, d) -> DataFrame:
    return assemble.chunk_sizes(_grouped(spark, d, "orders", CHUNKS), CHUNKS)


def row_group_sizes(spark, d):
    return assemble.group_sizes(_chunk_sizes(spark, d))


def relocate_offsets(spark, d):
    return assemble.relocate(_chunk_sizes(spark, d)).select("rg", "col", "sz", "start_off")


def copy_chunk(spark, d):
    return assemble.copy_chunk(_grouped(spark, d, "orders", ["o_orderstatus"]), 2, "o_orderstatus")


def recompress_roundtrip(spark, d):
    df = spark.read.parquet(table_path(d, "supplier"))
    to = scratch(spark, "recompress")
    return assemble.recompress(assemble.recompress(df, f"{to}/a", "zstd", 6), f"{to}/b", "snappy")


def assemble_in_memory(spark, d):
    """Two files built in memory by two tasks, of every other row group each; their bytes are read by another reader."""
    df = _grouped(spark, d, "orders", ["o_orderkey", "o_totalprice"]).withColumn("file_no", F.col("rg") % 2)
    made = writer.assemble_bytes(df, "rg", "ord", by="file_no")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = pq.ParquetFile(pa.BufferReader(row.content))
                for i in range(found.metadata.num_row_groups):
                    t = found.read_row_group(i).to_pandas()
                    yield t[["rg", "ord", "o_orderkey", "o_totalprice"]].assign(row_group=i, whole=len(row.content) == row.length)

    return made.mapInPandas(read, "rg long, ord long, o_orderkey long, o_totalprice double, row_group long, whole boolean")


def copy_and_fresh_chunks(spark, d):
    """Row groups of copied chunks beside newly encoded ones, as files in memory, read by another reader."""
    to = _written(spark, d)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                old = thrift.parse(r.head)[0]
                copied = next(c for c in chunks.chunks_of(r.path, thrift.parse(r.entry)[0]) if c.column == "c_custkey")
                keys = pq.ParquetFile(pa.BufferReader(chunks.assembled(old, [[copied]], schema=chunks.schema_of(old, ["c_custkey"])))).read()["c_custkey"]
                table = pa.table({"last_digit": pc.subtract(keys, pc.multiply(pc.divide(keys, 10), 10))})
                fresh = chunks.fresh_chunk(table)
                built = chunks.GroupBuilder(["last_digit", "c_custkey"]).add(copied).add(fresh).build()
                content = chunks.assembled(old, [built], schema=chunks.schema_of(old, ["last_digit", "c_custkey"], chunks.fresh_schema(table)))
                yield pq.ParquetFile(pa.BufferReader(content)).read().to_pandas().assign(rg=r.row_group)

    footer.ship(spark)
    groups = footer.dealt(footer.footers(spark, to, "group_entries"), "length")
    return groups.select("path", "row_group", "head", "entry").mapInPandas(build, "rg long, c_custkey long, last_digit long")


def assemble_upload(spark, d):
    """Row groups in reverse with two of the columns, put together from byte ranges and uploaded in parts."""
    to = _written(spark, d)
    chosen = ["c_name", "c_custkey"]
    groups = footer.footers(spark, to, "row_groups").select("path", "row_group", (-F.col("row_group")).alias("position"))
    target = scratch(spark, "uploaded") + ".parquet"
    split.assemble_files(spark, groups.withColumn("column", F.explode(F.array(*map(F.lit, chosen)))), target, chosen, wanted_parts=3, min_bytes=2_000)
    return o.scan(spark, target).select("ord", "c_name", "c_custkey")


def upload_parts(spark, d):
    """Parts put by tasks in any order become one object in order of their numbers."""
    target = scratch(spark, "parts") + ".txt"
    with stores.Upload(target) as upload:
        name = upload.id

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, text in batch.itertuples(index=False):
                    stores.Upload(target, upload=name).put_part(int(key) + 1, f"{text}\n".encode())
                    yield pd.DataFrame({"part": [int(key) + 1]})

        footer.ship(spark)
        nations = spark.read.parquet(table_path(d, "nation")).select("n_nationkey", "n_name")
        parts_put = [r.part for r in nations.repartition(4).mapInPandas(put, "part int").collect()]  # at most as many numbers as an upload has parts
        upload.known(parts_put).finish()
    return spark.read.text(target).select(F.col("value").alias("n_name"), F.col("_metadata.file_size").alias("size"))


def incremental_writer(spark, d):
    """Files written value by value, one row group at a time, with nulls; read back by another reader."""
    df = _grouped(spark, d, "orders", ["o_orderkey", "o_totalprice"]).withColumn("v", _optional("o_totalprice", "o_orderkey"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        sink = pa.BufferOutputStream()
        out = writer.OpenWriter(sink, pa.schema([pa.field("ord", pa.int64(), nullable=False), pa.field("v", pa.float64())]))
        group = out.start_row_group(len(rows))
        values, ordinals = group.column("v"), group.column("ord")
        for n, v in zip(rows["ord"].tolist(), rows["v"].tolist(), strict=True):
            ordinals.write(n)
            values.write_null() if v is None or v != v else values.write(v)
        group.write("v", values).write("ord", ordinals)
        out.finish_row_group()
        out.finish()
        read = pq.ParquetFile(pa.BufferReader(sink.getvalue())).read().to_pandas()
        return read.assign(rg=rows["rg"].iloc[0], is_null=read["v"].isna())

    footer.ship(spark)
    return df.groupBy("rg").applyInPandas(write, "rg long, ord long, is_null boolean, v double")


def write_checks(spark, d):
    """What writers refuse: another row count than declared, other columns than declared."""
    df = spark.read.parquet(table_path(d, "nation")).select("n_nationkey", "n_name")
    rows = df.count()
    out = []
    for case, options in (("right", {"declared_rows": rows, "columns": ["n_name", "n_nationkey"]}), ("rows", {"declared_rows": rows + 1}), ("column missing", {"columns": ["n_name", "n_nationkey", "n_comment"]}), ("column too many", {"columns": ["n_name"]})):
        try:
            writer.write_row_groups(df, to := scratch(spark, "checked"), 10, order=["n_nationkey"], **options)
            written = spark.read.parquet(to).count()
        except SchemaError:
            written = 0
        out.append((case, written))
    return spark.createDataFrame(out, "case string, num_rows long")


# Writers and footers


def _written(spark, d, rows: int = 300) -> str:
    to = scratch(spark, "written")
    df = _scan(spark, d, "customer")
    writer.write_row_groups(df, to, rows, order=["ord"], columns=df.columns)
    return to


def _files(spark, d) -> tuple[str, Column]:
    """Orders in files of four row groups of 1,000 rows; the number of a file."""
    to = scratch(spark, "files")
    writer.write_grouped_files(_scan(spark, d, "orders"), to, 1000, 4000)
    return to, F.regexp_extract("path", r"_file=(\d+)", 1).cast("long").alias("file_no")


def write_row_groups(spark, d):
    return footer.footers(spark, _written(spark, d), "row_groups").select("row_group", "start_row", "num_rows")


def write_grouped_files(spark, d):
    to, number = _files(spark, d)
    df = o.physical_groups(o.scan(spark, to, ["o_orderkey"]), footer.footers(spark, to, "row_groups"))
    return df.select(F.regexp_extract("file", r"_file=(\d+)", 1).cast("long").alias("file_no"), "rg", "pos_in_rg", "o_orderkey")


def physical_row_groups(spark, d):
    to = _written(spark, d)
    df = o.physical_groups(o.scan(spark, to, ["c_custkey"]), footer.footers(spark, to, "row_groups"))
    return df.select("rg", "pos_in_rg", "ord", "c_custkey")


def write_layout_roundtrip(spark, d):
    to = scratch(spark, "layout")
    df = spark.read.parquet(table_path(d, "orders"))
    writer.write_table(df, to, codec="zstd", level=4, dictionary=False, page_rows=500, version=2, rows_per_group=2000)
    return spark.read.parquet(to).select("o_orderkey", "o_orderstatus", "o_totalprice")


def page_layout(spark, d):
    """Codec, page version and values of every page, read from page headers in the chunks' bytes."""
    to = scratch(spark, "pages")
    df = _scan(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    writer.write_row_groups(df, to, 2000, order=["ord"], codec="snappy", dictionary=False, page_rows=500, version=2)
    listed = footer.footers(spark, to, "column_chunks").where("column <> 'ord'")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples():
                heads = chunks.page_headers(stores.read_range(r.path, r.start, r.length))
                found += [(r.row_group, r.column, i, kind, n, r.codec) for i, (kind, n, _) in enumerate(heads)]
            yield pd.DataFrame(found, columns=["row_group", "column", "page", "kind", "num_values", "codec"])

    footer.ship(spark)
    dealt = footer.dealt(listed.select("path", "row_group", "column", "codec", "start", "length"), "length")
    return dealt.mapInPandas(pages, "row_group long, `column` string, page long, kind string, num_values long, codec string")


def schema_order(spark, d):
    """Columns come back in the order in which they were written, not in that of the source."""
    to = scratch(spark, "order")
    df = spark.read.parquet(table_path(d, "region"))
    writer.write_table(df.select(*df.columns[::-1]), to)
    return schema_relation(spark.read.parquet(to), "region").select("position", "column", "type")


def infer_schema_types(spark, d):
    out = None
    for name in TABLES:
        one = schema_relation(spark.read.parquet(table_path(d, name)), name).select("table", "position", "column", "type")
        out = one if out is None else out.unionByName(one)
    return out


def footer_files(spark, d):
    to, number = _files(spark, d)
    found = footer.footers(spark, to, "files")
    return found.select(number, "num_rows", "num_row_groups", "num_columns", (F.col("footer_offset") + F.col("footer_length") + 8 == F.col("length")).alias("footer_at_end"))


def footer_row_groups(spark, d):
    to, number = _files(spark, d)
    return footer.row_group_starts(footer.footers(spark, to, "row_groups")).select(number, "row_group", "start_row", "num_rows")


def footer_column_chunks(spark, d):
    """Every chunk begins where the one before it ended, the first behind the magic."""
    to, number = _files(spark, d)
    found = footer.footers(spark, to, "column_chunks")
    order = Window.partitionBy("path").orderBy("row_group", "col")
    follows = F.col("start") == F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(4))
    return found.select(number, "row_group", "col", "column", "physical", "codec", "num_values", follows.alias("follows"))


def column_chunk(spark, d):
    found = footer.column_chunk(footer.footers(spark, _written(spark, d), "column_chunks"), 1, "c_name")
    return found.select("row_group", "col", "column", "physical", "num_values")


def footer_source(spark, d):
    footer.register(spark)
    to, number = _files(spark, d)
    found = spark.read.format("rowgrove_footers").option("relation", "files").load(to)
    return found.select(number, "num_rows", "num_row_groups", "num_columns")


def row_group_source(spark, d):
    footer.register(spark)
    to = _written(spark, d, 30)
    found = spark.read.format("rowgrove_row_groups").option("row_groups", "1,3").option("columns", "c_custkey,c_name").load(to)
    return found.select("rg", F.col("ord").alias("position"), "c_custkey", "c_name")


def row_group_reader(spark, d):
    """The second row group of every file, each read by a task of its own."""
    to, number = _files(spark, d)
    groups = footer.footers(spark, to, "row_groups").where("row_group = 1")
    like = footer.list_files(spark, to).orderBy("path").first().path
    found = footer.read_row_groups(spark, groups, ["o_orderkey", "o_totalprice"], like)
    return found.select(F.regexp_extract("file", r"_file=(\d+)", 1).cast("long").alias("file_no"), F.col("ord").alias("position"), "o_orderkey", "o_totalprice")


def raw_chunk_bytes(spark, d):
    """Raw bytes of every chunk, made a file of their own and read by another reader; the stream is opened twice."""
    to = _written(spark, d)
    listed = footer.footers(spark, to, "chunk_entries")
    heads = o.few(reliable(footer.footers(spark, to, "group_entries").where("row_group = 0").select("path", "head")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                chunk = chunks.Chunk(r.column, int(r.num_rows), r.entry, stores.Range(r.path, int(r.start), int(r.length)))
                with chunk.source.open() as one, chunk.source.open() as two:
                    again = one.read() == two.read() == r.bytes
                old = thrift.parse(r.head)[0]
                values = pq.ParquetFile(pa.BufferReader(chunks.assembled(old, [[chunk]], schema=chunks.schema_of(old, [r.column])))).read()[r.column].to_pylist()
                text = [f"{v:.2f}" if isinstance(v, float) else str(v) for v in values]
                yield pd.DataFrame({"row_group": [r.row_group], "column": [r.column], "num_values": [len(text)], "first_value": [text[0]], "last_value": [text[-1]], "largest": [max(text)], "again": [again]})

    return processors.raw_chunks(listed, ["num_rows", "entry"]).join(heads, "path").mapInPandas(read, "row_group long, `column` string, num_values long, first_value string, last_value string, largest string, again boolean")


def byte_ranges(spark, d):
    """Plain values taken from the ends of chunks by byte ranges, and both magics."""
    to = scratch(spark, "plain")
    df = _scan(spark, d, "events", ["event_id"])
    writer.write_row_groups(df.select("ord", "event_id"), to, 4000, order=["ord"], codec="none", dictionary=False, page_rows=1_000_000, page_bytes=1 << 30)
    listed = footer.footers(spark, to, "column_chunks").where("column = 'event_id'")
    asked = listed.select("path", "row_group", (F.col("start") + F.col("length") - 8 * F.col("num_values")).alias("start"), (8 * F.col("num_values")).alias("n"))
    ends = footer.byte_ranges(spark, to, [(0, 4), (-4, 4)]).agg(F.min_by("bytes", "start").alias("head"), F.max_by("bytes", "start").alias("tail"))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                found = np.frombuffer(r.bytes, "<i8")
                yield pd.DataFrame({"row_group": r.row_group, "pos": np.arange(len(found)), "event_id": found, "ends": (r.head + r.tail).decode()})

    met = footer.bytes_of_ranges(asked).join(F.broadcast(ends))
    return met.mapInPandas(values, "row_group long, pos long, event_id long, ends string")


# Splits and parts


def split_row_groups(spark, d):
    to = scratch(spark, "split")
    split.split_by_row_group(_grouped(spark, d, "orders", ["o_orderkey", "o_totalprice"]).drop("pos_in_rg"), to)
    return spark.read.parquet(to).select(F.col("rg").cast("long").alias("rg"), "ord", "o_orderkey", "o_totalprice")


def split_files(spark, d):
    """Files cut by row group without decoding; each is read by its own new footer."""
    to, number = _files(spark, d)
    target = scratch(spark, "cut")
    made = split.split_files(spark, to, target)
    placed = made.select(uri(F.col("file")).alias("_file"), number, "row_group")
    cut = o.scan(spark, target, ["o_orderkey", "o_totalprice"])
    return cut.join(o.few(placed), uri(F.col("file")) == F.col("_file")).select("file_no", "row_group", F.col("ord").alias("pos"), "o_orderkey", "o_totalprice")


def split_file_footers(spark, d):
    """In a file of one row group, chunks lie one behind the other from the magic on."""
    to, number = _files(spark, d)
    target = scratch(spark, "cut")
    made = split.split_files(spark, to, target)
    found = footer.footers(spark, target, "column_chunks")
    order = Window.partitionBy("path").orderBy("start")
    follows = F.col("start") == F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(4))
    cut = found.select(uri(F.col("path")).alias("_file"), F.col("row_group").alias("new_group"), "column", "num_values", follows.alias("follows"))
    return cut.join(made.select(uri(F.col("file")).alias("_file"), number, "row_group"), "_file").drop("_file")


def _group_spans(spark, d) -> DataFrame:
    placed = assemble.relocate(_chunk_sizes(spark, d))
    return placed.groupBy("rg").agg(F.min("start_off").alias("r_start"), F.max(F.col("start_off") + F.col("sz")).alias("r_end"))


def overlap_parts(spark, d):
    groups = _group_spans(spark, d)
    whole = groups.agg(F.max("r_end").alias("total"))
    fixed = split.data_parts(split.fixed_parts(whole, "total", PART_BYTES), 4, 1 << 60)
    return split.overlap(fixed, groups)


def overlap_at_boundaries(spark, d):
    """Parts that end exactly at, one byte before and one byte after the first boundary of row groups."""
    groups = _group_spans(spark, d)
    edge, end = groups.agg(F.min("r_end"), F.max("r_end")).first()
    cuts = [4, edge - 1, edge, edge + 1, end]
    spans = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))], "n long, p_start long, p_end long")
    return split.overlap(spans, groups)


def split_footer_offsets(spark, d):
    return split.split_footers(assemble.relocate(_chunk_sizes(spark, d))).select("rg", "col", "start_off", "moved_off")


def contiguity_check(spark, d):
    return split.contiguity(_group_spans(spark, d)).select("rg", "r_start", "r_end", "contiguous")


def part_offsets(spark, d):
    whole = _group_spans(spark, d).agg(F.max("r_end").alias("total"))
    fixed = split.fixed_parts(whole, "total", PART_BYTES)
    return split.part_offsets(fixed.select(F.col("n").alias("part_no"), (F.col("p_end") - F.col("p_start")).alias("size")))


def _plan(spark, d) -> tuple[DataFrame, DataFrame]:
    chunks = assemble.relocate(_chunk_sizes(spark, d)).withColumn("start_off", F.col("start_off") - 4)
    return chunks, parts.plan_table(chunks, PLANNED_PARTS, MIN_PART)


def plan_parts(spark, d):
    return _plan(spark, d)[1].select("n", "cut")


def group_chunks_in_parts(spark, d):
    chunks, cuts = _plan(spark, d)
    return parts.group_chunks(chunks, cuts, 4, FOOTER_BYTES).select("n", "num_chunks", "bytes")


def upload_buffers(spark, d):
    return parts.buffer_flushes(assemble.group_sizes(_chunk_sizes(spark, d)), BUFFER_BYTES).select("rg", "part", "buffered")


def max_part_check(spark, d):
    return parts.within_limits(_plan(spark, d)[1]).select("num_parts", "ok")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        row_group_index, row_group_totals, chunk_scan, chunk_scan_summary, row_group_scan_summary, row_group_processor, chunk_processor, read_chunk,
        project_known_columns, project_all, select_row_groups, skip_rows, skip_relative, null_iteration, null_count_by_chunk, global_row_position,
        dictionary_build, dictionary_encode, dictionary_decode, dictionary_benefit, dictionary_page_support, kv_first_wins, kv_written, append,
        append_three_sources, reorder_row_groups, add_column, assemble_select_columns, builder_row_mismatch, row_group_sizes, relocate_offsets, copy_chunk,
        recompress_roundtrip, assemble_in_memory, write_row_groups, physical_row_groups, write_layout_roundtrip, schema_order, infer_schema_types,
        footer_files, footer_row_groups, footer_column_chunks, footer_source, row_group_source, raw_chunk_bytes, byte_ranges, split_row_groups, overlap_parts,
        shared_dictionary, copy_and_fresh_chunks, assemble_upload, upload_parts, incremental_writer, write_checks, write_grouped_files, page_layout, column_chunk,
        row_group_reader, split_files, split_file_footers, upload_buffers, overlap_at_boundaries, split_footer_offsets, contiguity_check, part_offsets, plan_parts, group_chunks_in_parts, max_part_check,
    )
}
