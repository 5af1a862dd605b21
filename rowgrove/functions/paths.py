"""Folders for intermediate tables: always where all executors and the driver can reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors and the driver share.

    Where it is unset, a local session (one process, as in tests) gets a temporary folder; a cluster is an error.
    """
    named = spark.conf.get(SHARED, None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SHARED} names no folder that the executors share")
        named = _temporary.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="rowgrove-")
        _temporary[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, which outlives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def uri(path: Column) -> Column:
    """One spelling of local paths, which come with none, one or three slashes behind the scheme."""
    right = path.startswith("file:///") & ~path.startswith("file:////")  # as scans give them, without a regular expression for each row
    return F.when(right, path).otherwise(F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"^/", "file:///"))
