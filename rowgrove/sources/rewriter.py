"""Binary assembly: chunks copied without decoding, by the Parquet library that Spark ships, on files of one schema.

The copy runs in the driver's JVM, file by file, so it suits assembling a few files; tables are assembled with DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def rewrite(spark: SparkSession, inputs: Sequence[str], output: str, *, codec: str | None = None, drop: Sequence[str] = (), joined: Sequence[str] = ()) -> None:
    """Write ``output`` from the row groups of ``inputs`` in order, optionally recompressed, without some columns, or with columns of ``joined`` files beside."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path

    def paths(names: Sequence[str]):
        out = jvm.java.util.ArrayList()
        for n in names:
            out.add(path(n))
        return out

    conf = spark._jsc.hadoopConfiguration()
    build = jvm.org.apache.parquet.hadoop.rewrite.RewriteOptions.Builder
    options = build(conf, paths(inputs), paths(joined), path(output)) if joined else build(conf, paths(inputs), path(output))
    if codec:
        options = options.transform(getattr(jvm.org.apache.parquet.hadoop.metadata.CompressionCodecName, codec.upper()))
    if drop:
        names = jvm.java.util.ArrayList()
        for c in drop:
            names.add(c)
        options = options.prune(names)
    rewriter = jvm.org.apache.parquet.hadoop.rewrite.ParquetRewriter(options.build())
    rewriter.processBlocks()
    rewriter.close()
