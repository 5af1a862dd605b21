import io
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowgrove.plans import split
from rowgrove.sources import chunks, footer, stores, thrift, writer


def file_at(tmp_path, name="f.parquet", rows=10, groups=4, **options):
    table = pa.table({"k": pa.array(range(rows), pa.int64()), "t": [f"text {i % 3}" for i in range(rows)]})
    pq.write_table(table, tmp_path / name, row_group_size=groups, **options)
    return str(tmp_path / name), table


def test_footers_survive_parsing_and_writing(tmp_path):
    path, _ = file_at(tmp_path)
    content = open(path, "rb").read()
    raw, _ = footer.parse_footer(len(content), lambda a, n: content[a : a + n])
    assert thrift.dump(thrift.parse(raw)[0]) == raw


@pytest.mark.parametrize("value", [0, -1, 1, 300, -(1 << 40), (1 << 62)])
def test_thrift_numbers(value):
    fields = {1: (thrift.I64, value), 40: (thrift.TRUE, False), 41: (thrift.DOUBLE, 1.5), 60: (thrift.LIST, (thrift.I32, list(range(20)))), 61: (thrift.BYTE, -3)}
    assert thrift.parse(thrift.dump(fields)) == (fields, len(thrift.dump(fields)))
    with pytest.raises(ValueError):
        thrift.dump({1: (11, {})})


def test_groups_are_cut_with_new_footers(tmp_path):
    path, table = file_at(tmp_path, write_page_index=True)
    old = chunks.file_footer(path)[0]
    for g, (a, b) in enumerate([(0, 4), (4, 8), (8, 10)]):
        cut = pq.ParquetFile(pa.BufferReader(chunks.split_group(path, old, g)))
        assert cut.metadata.num_row_groups == 1 and cut.metadata.num_rows == b - a
        assert cut.read().equals(table.slice(a, b - a))
    with pytest.raises(footer.FooterError):
        chunks.split_group(path, old, 3)


def test_assembly_from_several_files(tmp_path):
    one, first = file_at(tmp_path, "a.parquet")
    two, second = file_at(tmp_path, "b.parquet", rows=3, compression="zstd", use_dictionary=False)
    old = chunks.file_footer(one)[0]
    groups = [chunks.group_chunks(two, chunks.file_footer(two)[0], 0), *[chunks.group_chunks(one, old, g) for g in (2, 0)]]
    found = pq.ParquetFile(pa.BufferReader(chunks.assembled(old, groups, pairs=[("a", "1"), ("a", "2")])))
    assert found.read().to_pydict() == pa.concat_tables([second, first.slice(8, 2), first.slice(0, 4)]).to_pydict()
    with pytest.raises(chunks.ChunkError):
        chunks.assembled(old, [])


def test_row_groups_are_built_whole(tmp_path):
    path, _ = file_at(tmp_path)
    k, t = chunks.file_chunk(path, 0, "k"), chunks.file_chunk(path, 0, "t")
    assert [c.column for c in chunks.GroupBuilder(["t", "k"]).add(k).add(t).build()] == ["t", "k"]
    with pytest.raises(chunks.ChunkError, match="already"):
        chunks.GroupBuilder(["k"]).add(k).add(k)
    with pytest.raises(chunks.ChunkError, match="missing: t"):
        chunks.GroupBuilder(["k", "t"]).add(k).build()
    with pytest.raises(chunks.ChunkError, match="2 rows"):
        chunks.GroupBuilder(["k", "t"]).add(k).add(chunks.file_chunk(path, 2, "t"))
    with pytest.raises(chunks.ChunkError, match="isn't in the schema"):
        chunks.GroupBuilder(["k"]).add(t)
    assert chunks.GroupBuilder(["k"]).add(k).num_bytes == k.length
    with pytest.raises(footer.FooterError):
        chunks.file_chunk(path, 0, "none")
    with pytest.raises(chunks.ChunkError):
        chunks.fresh_chunk(pa.table({"a": pa.array([], pa.int64())}))


def test_bloom_filters_stay_only_inside_the_bytes():
    meta = {thrift_number: (thrift.I64, 0) for thrift_number in (5, 6)} | {3: (thrift.LIST, (thrift.BINARY, [b"a"])), 7: (thrift.I64, 100), 9: (thrift.I64, 60), 10: (thrift.I64, 900), 11: (thrift.I64, 50)}
    for at, kept in ((120, 74), (2000, None)):
        entry = thrift.dump({2: (thrift.I64, 0), 3: (thrift.STRUCT, meta | {14: (thrift.I64, at), 15: (thrift.I32, 9)}), 4: (thrift.I64, 7)})
        moved = chunks.Chunk("a", 1, entry, b"").moved(4, (50, 200))
        found = moved[3][1]
        assert (found[9][1], found[11][1]) == (14, 4) and 10 not in found and 4 not in moved
        assert (found[14][1] if 14 in found else None) == kept and (15 in found) == (kept is not None)


def test_ranges_open_again(tmp_path):
    (tmp_path / "x").write_bytes(b"0123456789")
    span = stores.Range(str(tmp_path / "x"), 2, 5)
    with span.open() as one, span.open() as two:
        assert one.read(2) == b"23" and two.read() == b"23456" and one.read() == b"456" and one.read() == b""
    for start, n in ((8, 5), (-1, 2), (11, 1)):
        with pytest.raises(stores.StoreError):
            stores.Range(str(tmp_path / "x"), start, n).open()
    assert stores.read_range(str(tmp_path / "x"), -3, 3) == b"789"


def test_ranges_beyond_two_gigabytes(spark, tmp_path):
    path = tmp_path / "sparse.parquet"
    with open(path, "wb") as f:
        f.seek(3 << 30)
        f.write(b"end.")
    got = footer.byte_ranges(spark, str(path), [(3 << 30, 3), (-4, 4), (0, 2)]).orderBy("start", "n").collect()
    assert [bytes(r.bytes) for r in got] == [b"\0\0", b"end", b"end."]


def test_uploads(tmp_path):
    target, calls = str(tmp_path / "o"), []
    hooks = {k: lambda *a, k=k: calls.append((k, *a[1:])) for k in ("start", "part", "finish", "abort")}
    with stores.Upload(target, hooks=hooks) as up:
        assert (up.next_part(), up.next_part()) == (1, 2)
        stores.Upload(target, upload=up.id).put_part(2, b"b")
        up.put_part(1, b"x")
        up.put_part(1, b"a")
        assert up.known([2]).finish() == 2
    assert open(target, "rb").read() == b"ab" and [c[0] for c in calls] == ["start", "part", "part", "finish"] and calls[-1] == ("finish", [1, 2])
    with pytest.raises(stores.StoreError, match="finished"):
        up.put_part(3, b"")
    with pytest.raises(RuntimeError), stores.Upload(str(tmp_path / "p"), hooks=hooks) as broken:
        broken.put_part(1, b"a")
        raise RuntimeError
    assert sorted(x.name for x in tmp_path.iterdir()) == ["o"] and calls[-1] == ("abort",)
    with pytest.raises(stores.StoreError), stores.Upload(str(tmp_path / "q")) as empty:
        empty.finish()
    with pytest.raises(stores.StoreError), stores.Upload(str(tmp_path / "q")) as many:
        many.put_part(stores.MAX_PARTS + 1, b"")
    many = stores.Upload(str(tmp_path / "q"))
    many.given = stores.MAX_PARTS
    with pytest.raises(stores.StoreError):
        many.next_part()


def test_assembly_is_checked_before_uploading(spark, tmp_path):
    path, _ = file_at(tmp_path)
    rows = [(0, "k", path, 0), (0, "t", path, 2)]
    for bad, why in ((rows, "rows"), (rows[:1], "1 chunks"), ([rows[0], rows[0]], "1 columns"), ([(0, "k", path, 0), (0, "none", path, 0)], "found")):
        with pytest.raises(split.SplitError, match=why):
            split.assemble_files(spark, spark.createDataFrame(bad, "position long, column string, path string, row_group long"), str(tmp_path / "z"), ["k", "t"])
    assert [x.name for x in tmp_path.iterdir()] == ["f.parquet"]


def test_failed_splits_leave_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, _ = file_at(tmp_path / "in")
    content = open(path, "rb").read()
    size = struct.unpack("<I", content[-8:-4])[0]
    open(path, "wb").write(content[: 40] + content[-8 - size :])  # the footer stands, the bytes of the groups are gone
    with pytest.raises(Exception, match="ends at byte"):
        split.split_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [x.name for x in tmp_path.iterdir()] == ["in"]
    (tmp_path / "there").mkdir()
    with pytest.raises(split.SplitError, match="already exists"):
        split.split_files(spark, str(tmp_path / "in"), str(tmp_path / "there"))


def test_open_writer(tmp_path):
    schema = pa.schema([pa.field("a", pa.int64(), nullable=False), pa.field("b", pa.string())])
    sink = io.BytesIO()
    out = writer.OpenWriter(sink, schema)
    with pytest.raises(writer.WriterError, match="no row group"):
        out.current
    group = out.start_row_group(3)
    with pytest.raises(writer.WriterError, match="open already"):
        out.start_row_group(1)
    with pytest.raises(writer.WriterError, match="declared 3"):
        group.write("a", [1])
    b = group.column("b").write("x").write_null().write("y")
    group.write("b", b).write("a", [1, 2, 3])
    with pytest.raises(writer.WriterError, match="finished"):
        b.write("z")
    with pytest.raises(writer.WriterError, match="already"):
        group.write("a", [1, 2, 3])
    with pytest.raises(writer.WriterError, match="still open"):
        out.finish()
    out.finish_row_group()
    half = out.start_row_group(1)
    half.write("a", [4])
    with pytest.raises(writer.WriterError, match="missing: b"):
        out.finish_row_group()
    half.write("b", [None])
    out.finish_row_group()
    out.add("k", "1"), out.add("k", "2")
    out.finish()
    with pytest.raises(writer.WriterError, match="finished"):
        out.start_row_group(1)
    found = pq.ParquetFile(pa.BufferReader(sink.getvalue()))
    assert found.read().to_pydict() == {"a": [1, 2, 3, 4], "b": ["x", None, "y", None]} and found.metadata.num_row_groups == 2
    content = sink.getvalue()
    pairs = [p[2:] for p in footer.rows_of("p", len(content), lambda a, n: content[a : a + n], "kv")]
    assert [p for p in pairs if p[0] == "k"] == [("k", "1"), ("k", "2")]
    with pytest.raises(writer.WriterError, match="without row groups"):
        writer.OpenWriter(io.BytesIO(), schema).finish()
    with pytest.raises(writer.WriterError, match="no values"):
        writer.ValueWriter(schema.field("a")).finish()
    with pytest.raises(writer.WriterError, match="no nulls"):
        writer.ValueWriter(schema.field("a")).write(None)


def test_pages_are_read_from_their_headers(tmp_path):
    path, _ = file_at(tmp_path, rows=100, groups=100, data_page_version="2.0")
    for c in ("k", "t"):
        chunk = chunks.file_chunk(path, 0, c)
        heads = chunks.page_headers(chunk.read())
        assert heads[0][0] == "dictionary" and [h[:2] for h in heads[1:]] == [("v2", 100)] and sum(h[2] for h in heads) == chunk.length
