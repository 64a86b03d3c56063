"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of long texts that one task works on, at most about.
TASK_TEXTS = 5_000


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt by ``key``, for costly work on long texts: a file may have few row groups, and only
    these can be read apart. A task's share doesn't grow with the table."""
    rows = table(spark, sf_dir, name)
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_TEXTS))
    return rows.repartition(tasks, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
