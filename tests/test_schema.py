import pytest
from pyspark.sql import types as T

from rowgrove.functions import schema as s


def test_nested_and_repeated_columns_are_refused(spark, sf_dir):
    with pytest.raises(s.SchemaError, match="embedding"):
        s.validate_flat_schema(spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema)
    with pytest.raises(s.SchemaError, match="more than once"):
        s.validate_flat_schema(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("a", T.LongType())]))
    with pytest.raises(s.SchemaError, match="positive"):
        s.validate_flat_schema(T.StructType([s.fixed_binary("a", 0)]))


def test_descriptors(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    assert s.descriptor(schema, "o_custkey").dataType == T.LongType()
    assert s.descriptor(schema, "none") is None
    assert s.descriptor_at(schema, 0).name == "o_orderkey"
    with pytest.raises(IndexError):
        s.descriptor_at(schema, 99)


@pytest.mark.parametrize(
    ("kind", "physical"),
    [(T.DoubleType(), "DOUBLE"), (T.BooleanType(), "BOOLEAN"), (T.ShortType(), "INT32"), (T.DecimalType(9, 2), "INT32"), (T.DecimalType(18, 2), "INT64"), (T.DecimalType(30, 2), "FIXED_LEN_BYTE_ARRAY"), (T.BinaryType(), "BYTE_ARRAY"), (T.DateType(), "INT32")],
)
def test_physical_types(kind, physical):
    assert s.physical_type(kind) == physical


def test_required_and_fixed_lengths_are_checked(spark, tmp_path):
    declared = T.StructType([s.required("a", T.IntegerType()), s.fixed_binary("b", 4)])
    good = spark.createDataFrame([(1, b"abcd"), (2, b"efgh")], declared)
    good.write.parquet(str(tmp_path / "t"))
    back = s.with_declared(spark.read.parquet(str(tmp_path / "t")), declared)
    assert back.schema["a"].nullable and back.schema["b"].metadata == {"fixed_length": 4}
    assert s.require(back, declared).count() == 2
    bad = spark.createDataFrame([(None, b"abc")], "a int, b binary")
    with pytest.raises(s.SchemaError, match="a: 1 rows break required; b: 1 rows break length 4"):
        s.require(bad, declared)


def test_same_columns():
    s.same_columns(["b", "a"], ["a", "b"])
    with pytest.raises(s.SchemaError, match="missing: c; not in the schema: b"):
        s.same_columns(["a", "b"], ["a", "c"])
