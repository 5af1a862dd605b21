import pytest
from pyspark.sql import functions as F

from rowgrove.plans import dictionary, processors
from rowgrove.plans import ordinals as o
from rowgrove.sources import footer, writer

#: Every pattern of nulls in up to four rows; a value at every third place of a longer column is missing.
NULLS = [[None if bits >> i & 1 else 10 * i for i in range(n)] for n in range(1, 5) for bits in range(1 << n)]
SKIP = [None if i % 3 == 2 else i * i for i in range(13)]


def written(spark, tmp_path, values, kind="int", **layout):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n long, measure {kind}")
    layout.setdefault("rows_per_group", 1_000_000)
    writer.write_row_groups(df, str(tmp_path / "t"), layout.pop("rows_per_group"), order=["n"], **layout)
    return o.scan(spark, str(tmp_path / "t"))


def test_nulls_come_back_in_place(spark, tmp_path):
    rows = [(case, i, v) for case, values in enumerate(NULLS) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "case long, n long, measure int")
    writer.write_row_groups(df, str(tmp_path / "t"), 7, order=["case", "n"])
    back = o.iterate(o.scan(spark, str(tmp_path / "t")), "measure").orderBy("ord").collect()
    assert [(r.is_null, r.value) for r in back] == [(v is None, v) for _, _, v in rows]


def test_skip_at_every_row_of_small_pages(spark, tmp_path):
    df = o.logical_groups(written(spark, tmp_path, SKIP, page_rows=2), 100)
    for n in range(len(SKIP)):
        assert [r.measure for r in o.skip(df, n, len(SKIP)).orderBy("ord").collect()] == SKIP[n:]
    for n in (-1, len(SKIP)):
        with pytest.raises(o.RangeError):
            o.skip(df, n, len(SKIP))


def test_relative_skips():
    assert o.skip_positions([1, 2, 0, 1], 6) == [1, 3, 3, 4]
    with pytest.raises(o.RangeError):
        o.skip_positions([1, -1], 6)
    with pytest.raises(IndexError):
        o.skip_positions([4, 2], 6)


def test_physical_groups_follow_uneven_footers(spark, tmp_path):
    path = str(tmp_path / "uneven")
    df = spark.createDataFrame([(g, i, i) for g, (a, b) in enumerate([(0, 2), (2, 3), (3, 203)]) for i in range(a, b)], "rg long, ord long, v long")
    writer.store_bytes(writer.assemble_bytes(df, "rg", "ord"), path)
    groups = footer.footers(spark, path, "row_groups")
    assert [tuple(r) for r in groups.select("start_row", "num_rows").orderBy("row_group").collect()] == [(0, 2), (2, 1), (3, 200)]
    back = o.physical_groups(o.scan(spark, path, ["v"]), groups)
    assert back.count() == 203 and back.where((F.col("v") == 2) & (F.col("rg") == 1) & (F.col("pos_in_rg") == 0)).count() == 1


def test_index_checks(spark, sf_dir):
    df = o.logical_groups(o.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"]), 4096)
    index = o.row_group_index(df)
    assert o.start_of_group(o.check_index(index, 15_000), 3) == (12_288, 2712)
    with pytest.raises(o.RangeError):
        o.start_of_group(index, 4)
    with pytest.raises(o.RangeError):
        o.check_index(index, 1)
    with pytest.raises(KeyError):
        o.read_chunk(df, 0, "none")
    with pytest.raises(o.RangeError):
        o.read_chunk(df, -1, "o_orderkey")
    with pytest.raises(o.RangeError):
        o.logical_groups(df, 0)


def test_ordinals_of_many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartition(3).write.parquet(path)
    df = o.logical_groups(o.scan(spark, path), 100)
    index = o.row_group_index(df)
    assert index.agg(F.sum("num_rows")).first()[0] == 1000
    assert index.where("rg = 0 AND start_row <> 0").count() == 0


def test_dictionary_round_trip_with_nulls(spark, tmp_path):
    values = [5, None, 7, 5, 5, None, 9, 7]
    df = o.logical_groups(written(spark, tmp_path, values), 4)
    made = dictionary.build(df, "measure")
    assert [tuple(r) for r in made.select("rg", "id", "value").orderBy("rg", "id").collect()] == [(0, 0, 5), (0, 1, 7), (1, 0, 5), (1, 1, 9), (1, 2, 7)]
    back = dictionary.decode(dictionary.encode(df, "measure", made), made)
    assert [r.value for r in back.orderBy("ord").collect()] == values


def test_dictionary_pages_where_values_repeat(spark, tmp_path):
    df = spark.range(10_000).select(F.col("id").alias("n"), F.xxhash64("id").alias("various"), (F.col("id") % 100).alias("few"))
    writer.write_row_groups(df, str(tmp_path / "d"), 20_000, order=["n"], dictionary_bytes=1000, page_rows=1000)
    chunks = {r.column: r for r in footer.footers(spark, str(tmp_path / "d"), "column_chunks").collect()}
    assert "RLE_DICTIONARY" in chunks["few"].encodings or "PLAIN_DICTIONARY" in chunks["few"].encodings
    assert chunks["few"].start == chunks["few"].dictionary_offset < chunks["few"].data_offset
    assert chunks["various"].length > chunks["few"].length


def test_processors_see_groups_in_order(spark, sf_dir):
    import pandas as pd

    df = o.logical_groups(o.scan(spark, f"{sf_dir}/events.parquet", ["event_id"]), 4096)
    seen = processors.process_row_groups(df, lambda g: pd.DataFrame({"ok": [bool((g["event_id"].diff().dropna() == 1).all())], "n": [len(g)]}), "ok boolean, n long")
    assert sorted((r.ok, r.n) for r in seen.collect()) == [(True, 1808), (True, 4096), (True, 4096)]
