"""Tables written to the folder that every executor and the driver share.

They cut lineage: a lost executor loses no part of them, and a later job reads them again
instead of recomputing the texts. The folder is the one named by ``spark.checkpoint.dir``. Operators write some of
their tables when they are called, not when their result is read; those that the result still reads stay until ``clear``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; on a local master without one, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="memlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/memlake-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back with the same schema."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "__dict__", {}).get("_staged_at"):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this application; results not written yet can no longer be read."""
    _delete(spark, _home(spark))
