import pytest
from pyspark.sql import functions as F

from rowgrove.functions.schema import SchemaError
from rowgrove.plans import assemble, parts, split
from rowgrove.plans import ordinals as o
from rowgrove.sources import footer, rewriter, writer

M = parts.MIN_PART_BYTES


@pytest.mark.parametrize(
    ("wanted", "offsets", "cuts"),
    [
        (1, [0, M], [0, M]), (2, [0, M, 2 * M], [0, M, 2 * M]), (3, [0, M, 2 * M, 3 * M], [0, M, 2 * M, 3 * M]), (2, [0, M, 2 * M, 3 * M], [0, 2 * M, 3 * M]),
        (2, [0, M, 2 * M - 1], [0, 2 * M - 1]), (2, [0, M - 1, M], [0, M]), (1, [0, M - 1], None), (4, [0, 1], None),
    ],
)
def test_part_plans(wanted, offsets, cuts):
    assert parts.plan_parts(wanted, offsets) == cuts


def test_part_plan_errors_and_buffering():
    with pytest.raises(ValueError):
        parts.plan_parts(1, [1, M])
    assert parts.single_part(None, 7, last=False) is None
    assert parts.single_part(None, 7, last=True) == [0, 7]
    assert parts.single_part([0, 9], 9, last=False) == [0, 9]


def _groups(spark, sizes):
    rows = [(g, i, float(i)) for g, (a, b) in enumerate(zip([0, *sizes], sizes, strict=False)) for i in range(a, b)]
    return spark.createDataFrame(rows, "rg long, ord long, v double")


def test_reversed_groups(spark):
    df = _groups(spark, [1, 2])
    index = df.groupBy("rg").agg(F.min("ord").alias("start_row"), F.count("*").alias("num_rows"))
    assert [r.v for r in assemble.reorder(df, index).orderBy("new_ord").collect()] == [1.0, 0.0]


def _two_files(spark):
    """Two files whose row groups have the same numbers, the second one's longer."""
    rows = [(f, g, g * n + i, 100 * j + 10 * g + i) for j, (f, n) in enumerate((("a", 2), ("b", 3))) for g in (0, 1) for i in range(n)]
    return spark.createDataFrame(rows, "file string, rg long, ord long, v long")


def test_groups_of_several_files_are_kept_apart(spark):
    df = _two_files(spark)
    index = o.row_group_index(df)
    assert [tuple(r) for r in o.number_groups(index).orderBy("group_no").select("file", "rg", "start_row", "table_start").collect()] == [("a", 0, 0, 0), ("a", 1, 2, 2), ("b", 0, 0, 4), ("b", 1, 3, 7)]
    moved = assemble.reorder(df, index).orderBy("new_ord").collect()
    assert [r.new_ord for r in moved] == list(range(10)) and [r.v for r in moved] == [110, 111, 112, 100, 101, 102, 10, 11, 0, 1]
    extra = df.select((F.when(F.col("file") == "a", "x").otherwise("y")).alias("file"), "rg", "ord", (F.col("v") + 1).alias("w"))
    beside = assemble.add_column(df, extra, ["w"])
    assert beside.count() == 10 and beside.where("w <> v + 1").isEmpty()
    assert o.read_chunk(df, 1, "v").count() == 5 and o.read_chunk(df, 1, "v", file="b").count() == 3
    assert assemble.copy_chunk(df, 1, "v", declared_rows=2, file="a").count() == 2
    assert {(r.file, r.rg): r.num_values for r in o.null_counts(df, "v").collect()} == {("a", 0): 2, ("a", 1): 2, ("b", 0): 3, ("b", 1): 3}
    with pytest.raises(o.RangeError, match="several files"):
        o.start_of_group(index, 1)
    assert o.start_of_group(index, 1, "b") == (3, 3)
    with pytest.raises(assemble.AssemblyError, match="grouped by"):
        assemble.reorder(df, index.drop("file"))


def test_repeated_ordinals_are_refused(spark):
    df = _two_files(spark).drop("file")
    with pytest.raises(assemble.AssemblyError, match="ordinals"):
        assemble.add_column(df, df.withColumnRenamed("v", "w"), ["w"])


def test_append_checks_columns(spark):
    a, b = spark.createDataFrame([(0, 1)], "ord long, x int"), spark.createDataFrame([(0, 1)], "ord long, y int")
    with pytest.raises(SchemaError):
        assemble.append([a, b])
    with pytest.raises(assemble.AssemblyError):
        assemble.append([])


def test_added_columns_need_equal_groups(spark):
    base, extra = _groups(spark, [2, 5]), _groups(spark, [2, 5]).withColumnRenamed("v", "w")
    assert assemble.add_column(base, extra, ["w"]).where("v = w").count() == 5
    with pytest.raises(assemble.AssemblyError, match="row group 1"):
        assemble.add_column(base, extra.where("ord < 4"), ["w"])
    with pytest.raises(assemble.AssemblyError, match="already"):
        assemble.add_column(base, extra, ["v"])


def test_copied_chunks_are_counted(spark):
    df = _groups(spark, [2, 5])
    assert assemble.copy_chunk(df, 1, "v", declared_rows=3).count() == 3
    with pytest.raises(assemble.AssemblyError):
        assemble.copy_chunk(df, 1, "v", declared_rows=4)


def test_select_refuses_unknown_columns(spark):
    with pytest.raises(SchemaError):
        assemble.select_columns(_groups(spark, [2]), ["v", "none"])


def test_contiguity(spark):
    good = spark.createDataFrame([(0, 4, 10), (1, 10, 20)], "rg long, r_start long, r_end long")
    split.require_contiguous(good)
    for bad in ([(0, 4, 10), (1, 11, 20)], [(0, 4, 4)], [(0, 5, 9)]):
        with pytest.raises(split.SplitError):
            split.require_contiguous(spark.createDataFrame(bad, "rg long, r_start long, r_end long"))


def test_split_refuses_existing_targets(spark, tmp_path):
    df = _groups(spark, [2, 5])
    split.split_by_row_group(df, str(tmp_path / "s"))
    with pytest.raises(split.SplitError, match="already exists"):
        split.split_by_row_group(df, str(tmp_path / "s"))
    files = footer.footers(spark, str(tmp_path / "s"), "files").collect()
    assert sorted(f.num_rows for f in files) == [2, 3]


def test_parts_in_the_footer_are_left_out(spark):
    spans = spark.createDataFrame([(0, 0, 10), (1, 10, 20), (2, 20, 30)], "n long, p_start long, p_end long")
    assert [tuple(r) for r in split.data_parts(spans, 4, 15).orderBy("n").collect()] == [(0, 4, 10), (1, 10, 15)]


@pytest.mark.parametrize("rows", [1, 2, 7, 100, 10_000])
@pytest.mark.parametrize("per_group", [3, 1_000])
@pytest.mark.parametrize("columns", [1, 5])
def test_write_split_sweep(spark, tmp_path, rows, per_group, columns):
    if rows > 1000 and per_group == 3:
        pytest.skip("thousands of files")
    df = spark.range(rows).select(F.col("id").alias("ord"), *[F.rand(rows ^ per_group ^ c).alias(f"d{c}") for c in range(columns)])
    df = spark.createDataFrame(df.toPandas(), df.schema)
    to = str(tmp_path / "w")
    writer.write_row_groups(df, to, per_group, order=["ord"])
    groups = footer.footers(spark, to, "row_groups").orderBy("row_group").collect()
    assert [g.num_rows for g in groups] == [min(per_group, rows - a) for a in range(0, rows, per_group)]
    assert assemble.row_counts([(spark.read.parquet(to), rows)]).first().ok
    assert spark.read.parquet(to).exceptAll(df).isEmpty()


def test_grouped_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("ord"))
    writer.write_grouped_files(df, str(tmp_path / "g"), 100, 500)
    files = footer.footers(spark, str(tmp_path / "g"), "files").collect()
    assert sorted((f.num_rows, f.num_row_groups) for f in files) == [(500, 5), (500, 5)]
    with pytest.raises(SchemaError):
        writer.write_grouped_files(df, str(tmp_path / "h"), 100, 250)


def test_writer_checks(spark, tmp_path):
    df = spark.range(3).toDF("a")
    with pytest.raises(SchemaError, match="not the declared"):
        writer.write_row_groups(df, str(tmp_path / "x"), 2, declared_rows=4)
    with pytest.raises(SchemaError, match="without row groups"):
        writer.write_row_groups(df.where("false"), str(tmp_path / "x"), 2)
    with pytest.raises(SchemaError, match="missing: b"):
        writer.write_row_groups(df, str(tmp_path / "x"), 2, columns=["a", "b"])
    with pytest.raises(SchemaError, match="codec"):
        writer.write_options(codec="lzo")


@pytest.mark.parametrize("codec", ["none", "snappy", "zstd"])
def test_codecs(spark, tmp_path, codec):
    df = spark.range(1000).toDF("a")
    writer.write_table(df, str(tmp_path / "c"), codec=codec)
    found = {r.codec for r in footer.footers(spark, str(tmp_path / "c"), "column_chunks").collect()}
    assert found == {"UNCOMPRESSED" if codec == "none" else codec.upper()}


def test_binary_rewrite(spark, tmp_path):
    df = _groups(spark, [300, 1000]).select("ord", "v")
    writer.write_row_groups(df, str(tmp_path / "a"), 400, order=["ord"], codec="snappy")
    source = footer.list_files(spark, str(tmp_path / "a")).first().path
    target = str(tmp_path / "b.parquet")
    rewriter.rewrite(spark, [source, source], target, codec="zstd", drop=["v"])
    assert footer.footers(spark, target, "files").select("num_rows", "num_row_groups", "num_columns").first() == (2000, 6, 1)
    assert footer.footers(spark, target, "column_chunks").first().codec == "ZSTD"


def test_assembled_table_reads_by_point(spark, tmp_path):
    df = _groups(spark, [2, 5])
    writer.store_bytes(writer.assemble_bytes(df, "rg", "ord"), str(tmp_path / "m"))
    footer.register(spark)
    got = spark.read.format("rowgrove_row_groups").option("row_groups", "1").option("columns", "v").load(str(tmp_path / "m"))
    assert got.columns == ["file", "rg", "ord", "v"] and got.rdd.getNumPartitions() == 1
    assert [(r.ord, r.v) for r in got.orderBy("ord").collect()] == [(2, 2.0), (3, 3.0), (4, 4.0)]
    assert o.project(got, ["v", "none"]).columns == ["v"]
