import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowgrove.sources import footer
from rowgrove.streaming.append import append_arrivals


def reader(content):
    return lambda start, n: content[start : start + n]


def file_of(table, **options):
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, **options)
    return sink.getvalue().to_pybytes()


def test_magic_is_checked_at_both_ends():
    good = file_of(pa.table({"a": [1, 2]}))
    assert footer.parse_footer(len(good), reader(good))[1] > 4
    for bad in (b"", b"PAR1PAR1", b"XXXX" + good[4:], good[:-4] + b"XXXX", b"PAR1" + struct.pack("<I", 1 << 30) + b"PAR1" * 2):
        with pytest.raises(footer.FooterError):
            footer.parse_footer(len(bad), reader(bad))


def test_long_footers_take_a_second_read():
    wide = file_of(pa.table({f"column_{i}": [i] for i in range(2000)}))
    raw, at = footer.parse_footer(len(wide), reader(wide))
    assert len(raw) > footer.TAIL_BYTES and at + len(raw) + 8 == len(wide)
    assert len(list(footer.rows_of("p", len(wide), reader(wide), "column_chunks"))) == 2000


def test_repeated_keys_keep_their_order():
    table = pa.table({"a": [1]}).replace_schema_metadata(pa.KeyValueMetadata([("k", "1"), ("k", "2"), ("j", "3")]))
    content = file_of(table)
    found = [r[1:] for r in footer.rows_of("p", len(content), reader(content), "kv")]
    assert found[:3] == [(0, "k", "1"), (1, "k", "2"), (2, "j", "3")]


@pytest.mark.parametrize(("dictionary", "data", "start"), [(None, 40, 40), (0, 40, 40), (4, 40, 4), (50, 40, 40)])
def test_chunk_start(dictionary, data, start):
    assert footer.chunk_start(dictionary, data) == start


def test_chunk_start_is_behind_the_magic():
    with pytest.raises(footer.FooterError):
        footer.chunk_start(None, 3)


def test_custom_metadata(spark, tmp_path):
    table = pa.table({"height": [0, 2], "weight": [1, 3]}).replace_schema_metadata({"origin": "field 7"})
    pq.write_table(table, tmp_path / "f.parquet", row_group_size=1)
    kv = footer.footers(spark, str(tmp_path / "f.parquet"), "kv")
    assert footer.custom_metadata(kv, "origin") == "field 7" and footer.custom_metadata(kv, "origi") is None
    chunks = footer.footers(spark, str(tmp_path / "f.parquet"), "column_chunks")
    assert footer.column_chunk(chunks, 1, "weight").first().num_values == 1
    for group, column in ((2, "height"), (0, "none")):
        with pytest.raises(footer.FooterError):
            footer.column_chunk(chunks, group, column)
    with pytest.raises(footer.FooterError):
        footer.footers(spark, str(tmp_path), "none")


def test_files_without_pairs_have_none(spark, tmp_path):
    pq.write_table(pa.table({"a": [1]}), tmp_path / "f.parquet", store_schema=False)
    assert footer.footers(spark, str(tmp_path), "kv").count() == 0


def test_types_that_the_scan_refuses(spark, tmp_path):
    import numpy as np

    table = pa.table({"half": pa.array([np.float16(1.5), None]), "t": pa.array([1, 2], pa.time32("ms")), "fixed": pa.array([b"12", b"34"], pa.binary(2)), "ns": pa.array([1, 2], pa.timestamp("ns"))})
    pq.write_table(table, tmp_path / "f.parquet")
    footer.register(spark)
    df = spark.read.format("rowgrove_row_groups").load(str(tmp_path / "f.parquet"))
    assert [(bytes(r.half) if r.half is not None else None, r.t, bytes(r.fixed), r.ns) for r in df.orderBy("ord").collect()] == [(struct.pack("<e", 1.5), 1, b"12", 1), (None, 2, b"34", 2)]
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("rowgrove_row_groups").option("columns", "none").load(str(tmp_path / "f.parquet")).count()


def test_byte_ranges(spark, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"0123456789abcde01234567")
    got = footer.byte_ranges(spark, str(tmp_path / "x.parquet"), [(5, 10), (-3, 3)]).orderBy("start").collect()
    assert [bytes(r.bytes) for r in got] == [b"56789abcde", b"567"]
    with pytest.raises(Exception, match="beyond the end"):
        footer.byte_ranges(spark, str(tmp_path / "x.parquet"), [(20, 10)]).collect()


def test_other_schemes_read_through_spark(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, 2, 3]}), tmp_path / "f.parquet", row_group_size=2)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.rows.link./t", f"file://{tmp_path}")
    found = footer.footers(spark, "viewfs://rows/t/f.parquet", "row_groups").orderBy("row_group")
    assert [r.num_rows for r in found.collect()] == [2, 1]


def test_arrivals_are_appended_once(spark, tmp_path):
    arrivals, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(10).write.mode("append").parquet(arrivals)
    for n in (10, 15):
        append_arrivals(spark, spark.read.parquet(arrivals).schema, arrivals, table, checkpoint, codec="snappy").awaitTermination()
        assert spark.read.parquet(table).agg(F.count("*")).first()[0] == n
        spark.range(5).write.mode("append").parquet(arrivals)
