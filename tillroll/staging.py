"""Intermediate tables in the cluster's shared checkpoint folder.

A frame is staged when several jobs must see exactly the same rows: float sums and
sampled range bounds may differ from one evaluation to the next, and a lost executor
re-evaluates.  A written table is read back instead, columnar and with pushdown.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Folders of local sessions, removed when Python ends.
_LOCAL_SCRATCH: list[tempfile.TemporaryDirectory] = []


def staging_root(spark: SparkSession) -> str:
    """This application's folder below `spark.checkpoint.dir`."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        scratch = tempfile.TemporaryDirectory(prefix="tillroll-", ignore_cleanup_errors=True)
        _LOCAL_SCRATCH.append(scratch)
        root = scratch.name
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tillroll-{context.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "frame") -> DataFrame:
    """Write `df` once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete everything this application staged."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
