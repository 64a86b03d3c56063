"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import bound_batches, tidy

FILE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32(), nullable=False)))])


def encode_sorted(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Rows (doc_id, part, row, ids) in ascending doc_id, nulls first; ties by text.

    ``part`` and ``row`` number the range partitions and the rows in each, so that the order of
    the whole table can be had from the files alone. Null and empty texts have the end id alone;
    repeated rows are encoded once each; an empty table gives no rows; columns other than doc_id and
    text are ignored.
    """
    from pyspark import TaskContext

    bound_batches(docs.sparkSession)
    path = tokenizer_path or tokens.default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, part, row = tokens.encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in tokens.batches_of_texts(batch):
                coded = [c + end for c in enc.encode(texts)]
                n = len(coded)
                offsets = np.zeros(n + 1, dtype=np.int32)
                np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.record_batch([ids.slice(first, n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), lists.cast(_ARROW.field("ids").type)], schema=_ARROW)
                row += n

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    n = [partitions] if partitions else []
    return rows.repartitionByRange(*n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(run, "tokens"), FILE_SCHEMA)


def write_token_files(encoded: DataFrame, path: str, stripe_bytes: int = 16 << 20, bloom_fpp: float = 0.01) -> None:
    """Write as ORC, sorted as given. Stripes of ``stripe_bytes`` are read in parallel; row
    indexes and stripe statistics on doc_id (sorted) prune ranges, Bloom filters prune points. A
    table without rows leaves a folder without rows; null ids are stored as such."""
    (encoded.write.format("orc").option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
     .option("orc.create.index", "true").option("orc.row.index.stride", 1000).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", bloom_fpp).save(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; the filter reaches the ORC reader (statistics, Bloom filters)."""
    return read_token_files(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _crc_of_ids(ids: Column) -> Column:
    @F.arrow_udf("long")
    def run(lists: pa.Array) -> pa.Array:
        flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        data, first = np.ascontiguousarray(flat, "<i4"), off.tolist()
        return pa.array([zlib.crc32(data[a:b].data) for a, b in zip(first, first[1:])], pa.int64())

    return run(ids)


def describe_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored row; start counts all ids before it.

    Within a part a running sum, plus the total of the parts before: the only unpartitioned
    window runs over one row per part. Rows that share an id, null ids among them, have a row each;
    files without rows give none.
    """
    light = files.select("doc_id", "part", "row", F.size("ids").cast("long").alias("n_tokens"), _crc_of_ids(F.col("ids")).alias("ids_crc32"))
    parts = files.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    before = parts.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return (light.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, "part")
            .select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"))
