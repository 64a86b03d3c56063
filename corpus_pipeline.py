"""From documents to packed training sequences: five stages, each over all that the one before
kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import langid, linededup, mixing, ngram_join, packing
from clausemill.llm.common import count_words, fold_remainder, materialise, read, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = 0.3) -> DataFrame:
    """Language ID, learnt from three quarters of the labelled documents. Rejected are texts
    without a letter (and null texts), and those that no language reaches ``least_score`` for."""
    docs = docs.select(*COLUMNS)
    train = docs.filter(F.coalesce(fold_remainder(F.col("doc_id"), 4) != 2, F.lit(False)))
    out = langid.identify(docs, train)
    return out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least_score)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_docs: int = 10) -> DataFrame:
    """Lines that stand in ``min_docs`` or more documents go everywhere; every document stays,
    if need be with an empty text. n_chars is counted anew."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), min_docs=min_docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id (null
    first, then by row hash); documents without words all stay. Rows that repeat an id and its
    text are one document; rows that share an id but not a text are judged apart."""
    docs = docs.select(*COLUMNS)
    rows = docs.withColumns(dict(zip(("rk1", "rk2"), row_key(F.col("doc_id"), F.col("text")))))
    groups = materialise(ngram_join.jaccard_components(rows, n=5, percent=75, keep=("rk1", "rk2")), "groups")
    chosen = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "rk1", "rk2")).alias("k")).select("k.rk1", "k.rk2")
    stay = chosen.unionByName(groups.filter("component IS NULL").select("rk1", "rk2"))
    out = rows.join(stay, ["rk1", "rk2"], "left_semi")
    if not groups.groupBy("rk1", "rk2").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["rk1", "rk2"])
    return out.select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to source targets: documents it takes twice stand twice, those it doesn't take go.
    Rows that are alike share the largest repeat count among them."""
    docs = docs.select(*COLUMNS)
    key = dict(zip(("rk1", "rk2"), row_key(F.col("doc_id"), F.col("source"), F.col("text"))))
    light = docs.select("doc_id", count_words(F.col("text")).alias("size"), F.array("source").alias("sources"), *[c.alias(k) for k, c in key.items()])
    rows, _ = mixing.mix_sources(light, keep=["rk1", "rk2"])
    repeats = rows.filter("repeats > 0").groupBy("rk1", "rk2").agg(F.max("repeats").alias("repeats"))
    out = docs.withColumns(key).join(repeats, ["rk1", "rk2"])
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of at most 2048 tokens a sequence."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("source_mix", mixing_stage),
    ("packing", packing_stage),
]

#: A trained classifier, seeded hashes and a tokenizer are beyond SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
