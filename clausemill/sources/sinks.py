"""Tables written: vector indexes by name, JSON lines, a keyed cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_index(vectors: DataFrame, path: str) -> None:
    """Write vectors (with their norm worked out once) partitioned by namespace."""
    rows = _with_norm(vectors)
    rows.write.mode("overwrite").partitionBy("namespace").parquet(path)


def scalar_metadata(*columns: str, schema) -> Column:
    """Metadata that a vector store takes: a map of texts. Texts, numbers and flags stay what they
    are, times are ISO, everything else is JSON; nulls are left out."""
    def shown(name: str) -> Column:
        kind, c = schema[name].dataType, F.col(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")

    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), shown(n).alias("v")) for n in columns]), lambda x: x["v"].isNotNull())
    return F.map_from_entries(pairs)


def _dynamic(rows: DataFrame, path: str) -> None:
    """Replace the namespaces that ``rows`` has, and leave the files of all others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)


def _with_norm(vectors: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.withColumn("vector_norm", norm)
    return rows if "namespace" in rows.columns else rows.withColumn("namespace", F.lit("default"))


def _named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of some namespaces, by partition pruning; names stay texts."""
    with_names = spark.read.parquet(path)
    schema = T.StructType([f if f.name != "namespace" else T.StructField("namespace", T.StringType()) for f in with_names.schema])
    return spark.read.schema(schema).parquet(path).filter(F.col("namespace").isin(names))


def upsert_index(new: DataFrame, path: str, id_col: str = "vec_id", batch_rows: int = 1_000_000) -> int:
    """Add the rows of ``new`` to a saved index, in place of those of the same namespace and id, and
    rewrite only the namespaces that it touches, in files of ``batch_rows`` rows at most. Returns how many
    rows were replaced. Of rows of ``new`` that share namespace and id one stays. Namespaces are
    few against the vectors: their names, at most 10,000, pass the driver."""
    spark, rows = new.sparkSession, _with_norm(new).dropDuplicates(["namespace", id_col])
    names = [r[0] for r in rows.select("namespace").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 namespaces in one upsert")
    old = _named(spark, path, names)
    keys = rows.select("namespace", id_col)
    replaced = old.join(keys, ["namespace", id_col], "left_semi").count()
    merged = rows.unionByName(old.join(keys, ["namespace", id_col], "left_anti"), allowMissingColumns=True)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", batch_rows).partitionBy("namespace").parquet(path)
    return replaced


def remove_from_index(spark: SparkSession, path: str, ids: DataFrame, namespace: str | None = None, id_col: str = "vec_id") -> int:
    """Remove vectors by id, in one namespace or all; only namespaces that hold some of them are
    rewritten, and one left empty loses its folder. Returns the number of vectors removed."""
    keys = ids.select(id_col).distinct()
    rows = load_index(spark, path, namespace)
    hit = rows.join(keys, id_col, "left_semi").groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).collect()
    if not hit:
        return 0
    names = [str(r["namespace"]) for r in hit]
    kept = _named(spark, path, names).join(keys, id_col, "left_anti")
    left = {str(r[0]) for r in kept.select("namespace").distinct().collect()}
    if left:
        _dynamic(kept, path)
    for name in set(names) - left:
        where, fs = _folder(spark, f"{path}/namespace={name}")
        fs.delete(where, True)
    return sum(r["n"] for r in hit)


def load_index(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """Read it back; a namespace prunes partitions."""
    rows = spark.read.parquet(path)
    return rows if namespace is None else rows.filter(F.col("namespace") == namespace)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def cache_key(text: Column, model: str) -> Column:
    """The name a text's value is cached under: the model and the text's digest."""
    return F.concat(F.lit(f"{model}:"), F.sha2(text.cast("binary"), 256))


def cached(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of texts against a cache keyed by content hash."""
    keyed = texts.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    return keyed.join(cache, "content_hash"), keyed.join(cache.select("content_hash"), "content_hash", "left_anti")


def looked_up(texts: DataFrame, cache: DataFrame, model: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """``texts`` (text needed) with cache_key, hit, and the entry's value, access_count (this read
    included) and age_seconds. ``cache`` has a row (cache_key, value, created_at, access_count,
    last_accessed) for each key. Entries of ``ttl_seconds`` or more don't count; blank and null texts
    are nobody's and have a null key."""
    key = F.when(F.length(F.btrim("text")) > 0, cache_key(F.col("text"), model))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    live = cache.select(F.col("cache_key").alias("_key"), "value", age.alias("age_seconds"), (F.col("access_count") + 1).alias("access_count")).filter(F.col("age_seconds") < ttl_seconds)
    rows = texts.withColumn("cache_key", key)
    return rows.join(live, rows["cache_key"] == live["_key"], "left").withColumn("hit", F.col("_key").isNotNull()).drop("_key")


def refreshed(cache: DataFrame, reads: DataFrame, made: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """The cache after a batch: entries read are counted and marked with ``now``, expired ones are
    gone, ``made`` (cache_key, value) are new. ``reads`` is what ``looked_up`` gave."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    hits = reads.filter("hit").groupBy("cache_key").agg(F.count(F.lit(1)).alias("_n"))
    old = cache.filter(age < ttl_seconds * 1_000_000).join(hits, "cache_key", "left")
    old = old.select("cache_key", "value", "created_at", (F.col("access_count") + F.coalesce("_n", F.lit(0))).alias("access_count"), F.when(F.col("_n") > 0, now).otherwise(F.col("last_accessed")).alias("last_accessed"))
    new = made.dropDuplicates(["cache_key"]).select("cache_key", "value", now.alias("created_at"), F.lit(0).cast("long").alias("access_count"), now.alias("last_accessed"))
    return new.unionByName(old.join(new.select("cache_key"), "cache_key", "left_anti"))


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved_indexes(spark: SparkSession, root: str) -> list[str]:
    """Names of the indexes saved under ``root``, sorted; none if there is no such folder."""
    where, fs = _folder(spark, root)
    return sorted(x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()) if fs.exists(where) else []


def delete_index(spark: SparkSession, root: str, name: str) -> bool:
    """Delete a saved index; whether there was one. Names lead nowhere but into ``root``."""
    if not name or "/" in name or name.startswith("."):
        raise ValueError(f"no name of an index: {name!r}")
    where, fs = _folder(spark, f"{root}/{name}")
    return fs.delete(where, True)
