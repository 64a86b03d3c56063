"""Shared helpers: scratch tables in the cluster's shared folder, row identities, word counts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the application ends.

    Only where that setting is unset (local tests) a folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there, so a
    lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, name)}/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    # The shuffles behind the table are done with. Executors delete their files once the driver's
    # references are collected, which a mostly idle driver would do much later.
    spark.sparkContext._jvm.System.gc()
    return out


def release(df: DataFrame) -> None:
    """Delete the table of a ``materialise``d frame that nothing reads any more."""
    remove_dir(df.sparkSession, df._scratch)


def bound_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Let Arrow batches hold ``most`` bytes where the session has the default of 64 MB: so many
    whole texts, with what is made of them, are more than a worker should hold at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{most}b")


def give_back() -> None:
    """Hand what Python has freed back to the system: workers live on between tasks and stages,
    beside other tasks' memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What this worker keeps between the tasks that use ``name`` (see ``tidy``)."""
    return _KEPT.setdefault(name, {})


def drop_others(name: str | None) -> None:
    for other, things in _KEPT.items():
        if other != name:
            things.clear()


def tidy(run, uses: str | None = None):
    """``run``, a function over a task's Arrow batches, that gives its memory back at the end.
    Workers live on from job to job: what they ``kept`` for others than ``uses`` goes first."""
    def tidied(batches):
        drop_others(uses)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def fold_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that together identify a row by its content."""
    return [F.xxhash64(*cols).alias("rk1"), F.xxhash64(F.lit(7), *reversed(cols)).alias("rk2")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
