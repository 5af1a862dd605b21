"""Files of many row groups: work that grows with their number, not with its square."""

import time

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowgrove.operators.oracles import ORACLES
from rowgrove.operators.queries import QUERIES
from rowgrove.plans import split
from rowgrove.sources import chunks, footer, thrift, writer

from .oracle import connect, same


@pytest.fixture(scope="module")
def many_groups(tmp_path_factory):
    """Tables with six times the customers of sf0.1: 300 row groups, 1,800 chunks."""
    import os

    to = tmp_path_factory.mktemp("groups")
    source = "/root/testdata/sf0.1"
    for f in os.listdir(source):
        if f != "customer.parquet":
            os.symlink(f"{source}/{f}", to / f)
    one = pq.read_table(f"{source}/customer.parquet").sort_by("c_custkey")
    step = pc.max(one["c_custkey"]).as_py() + 1
    pq.write_table(pa.concat_tables([one.set_column(0, one.schema.field(0), pc.add(one["c_custkey"], i * step)) for i in range(6)]), to / "customer.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["assemble_upload", "copy_and_fresh_chunks", "raw_chunk_bytes"])
def test_footers_are_parsed_once(name, spark, many_groups):
    """It took over 90 seconds when a footer was parsed for every chunk."""
    began = time.monotonic()
    same(QUERIES[name](spark, many_groups), connect(many_groups), ORACLES[name])
    assert time.monotonic() - began < 75


def test_entries_are_those_of_the_footer(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    pq.write_table(pa.table({"a": range(50), "b": [f"text {i % 3}" for i in range(50)], "c": [i % 2 == 0 for i in range(50)], "d": [i / 3 for i in range(50)]}), path, row_group_size=3, write_page_index=True)
    old, end = chunks.file_footer(path)
    whole = thrift.dump(old)
    head, spans = thrift.split_list(whole, chunks.GROUPS)
    assert head == {n: f for n, f in old.items() if n != chunks.GROUPS} == chunks.file_head(path)
    assert [thrift.parse(whole[a:b])[0] for a, b in spans] == old[chunks.GROUPS][1][1]
    for r in footer.footers(spark, path, "group_entries").collect():
        assert thrift.parse(bytes(r.entry))[0] == old[chunks.GROUPS][1][1][r.row_group] and r.data_end == end and thrift.parse(bytes(r.head))[0] == head
    found = footer.footers(spark, path, "chunk_entries").collect()
    expected = [c for g in range(17) for c in chunks.group_chunks(path, old, g)]
    assert [(r.column, r.start, r.length, r.num_rows, bytes(r.entry)) for r in found] == [(c.column, c.source.start, c.source.length, c.rows, c.entry) for c in expected]
    assert b"".join(chunks.read_each(expected)) == b"".join(c.read() for c in expected)


def test_many_files_share_tasks(spark, tmp_path):
    """Each group had a task and a report file of its own, up to 10,000, and each task parsed its file's footer."""
    for i in range(30):
        (tmp_path / "in" / f"n={i}").mkdir(parents=True)
        pq.write_table(pa.table({"a": range(i, i + 7)}), tmp_path / "in" / f"n={i}" / "f.parquet", row_group_size=3)
    made = split.split_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert made.count() == 90 and sum(pq.read_table(r.file)["a"].to_pylist() == list(range(n := i + 3 * r.row_group, min(n + 3, i + 7))) for r in made.collect() for i in [int(r.path.split("n=")[1].split("/")[0])]) == 90
    assert len(list(tmp_path.glob("out.report-*/*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism
    assert footer.tasks_for(spark, 54_000) <= 300 and footer.tasks_for(spark, 3) == 3 and footer.tasks_for(spark, 1000, 1 << 40) == 1000


@pytest.mark.parametrize("order", [["n"], ["few", "text"], ["text"]])
def test_a_file_is_sorted_in_pieces(order, spark, tmp_path, monkeypatch):
    """One task sorted the whole file: the memory of a task grew with the table."""
    monkeypatch.setattr(writer, "PIECE_ROWS", 1000, raising=False)
    df = spark.range(12_345).repartition(7).select(F.col("id").alias("n"), (F.col("id") % 3).alias("few"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("text "), F.col("id") % 97)).alias("text"))
    to = str(tmp_path / "out")
    for mode in ("overwrite", "overwrite"):
        writer.write_row_groups(df, to, 300, order=order, page_rows=100, mode=mode)
    files = list((tmp_path / "out").glob("*"))
    assert len([f for f in files if f.name.endswith(".parquet")]) == 1
    found = pq.ParquetFile(next(f for f in files if f.name.endswith(".parquet")))
    assert [found.metadata.row_group(i).num_rows for i in range(found.num_row_groups)] == [300] * 41 + [45]
    got, want = found.read().to_pandas(), df.orderBy(*order).toPandas()
    assert got[order].astype(str).equals(want[order].astype(str)) and got.sort_values("n").reset_index(drop=True).equals(want.sort_values("n").reset_index(drop=True))
    assert all(found.metadata.row_group(i).column(j).has_column_index and found.metadata.row_group(i).column(j).has_offset_index for i in range(42) for j in range(3))
    assert spark.read.parquet(to).where("n BETWEEN 5000 AND 5100 AND few = 1").count() == df.where("n BETWEEN 5000 AND 5100 AND few = 1").count()
    listed = footer.footers(spark, to, "row_groups").orderBy("row_group").collect()
    assert [r.start_row for r in listed] == [300 * i for i in range(42)]
    with pytest.raises(Exception, match="exists"):
        writer.write_row_groups(df, to, 300, order=order, mode="errorifexists")


def test_most_memory_of_a_task(spark, tmp_path, monkeypatch):
    """Rows of a piece go to one task each."""
    monkeypatch.setattr(writer, "PIECE_ROWS", 1000, raising=False)
    seen = []
    monkeypatch.setattr(writer, "_join_pieces", lambda spark, written, target: seen.extend(pq.ParquetFile(f).metadata.num_rows for f in __import__("pathlib").Path(written).rglob("*.parquet")), raising=False)
    writer.write_row_groups(spark.range(4500), str(tmp_path / "out"), 100, order=["id"])
    assert sorted(seen) == [500, 1000, 1000, 1000, 1000]
