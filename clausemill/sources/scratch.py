"""Folders for intermediate tables, shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the application ends. Only where
    that setting is unset and the master is local, one of this machine is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def bound_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Let Arrow batches hold ``most`` bytes where the session has the default of 64 MB: a worker
    holds a batch of texts several times over, with what is made of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{most}b")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read back, so that later reads don't work it out again."""
    path = f"{folder(df.sparkSession, name)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
