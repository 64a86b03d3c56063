"""Line de-duplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import BLANKS, lower_ascii, materialise, release, remove_dir, row_key, scratch_dir

#: This operator's own columns, named so that no table has them.
_R1, _R2, _GONE = "_line_row_1", "_line_row_2", "_line_gone"


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at either end, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hashes(key: Column) -> list[Column]:
    """128 bits in two columns: at 10^12 distinct lines a chance collision stays unlikely."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, fresh) in levels, as bucketed tables under one folder.

    A new batch is merge-anti-joined with the runs: keys that none of them holds are ``fresh`` in
    its own run, others only add to a count. When a level holds ``fanout`` runs they are merged
    into one run of the next level, so that N batches leave O(fanout * log N) runs and each hash
    is rewritten O(log N) times. All runs are bucketed and sorted alike by hash, so the merge joins
    read them where they lie and shuffle the new batch alone.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}

    def _write(self, level: int, rows: DataFrame) -> None:
        run = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("h1", "h2", "n_docs", "fresh").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{run}").saveAsTable(run)
        self.levels.setdefault(level, []).append(run)

    def _rows(self, runs: list[str]) -> DataFrame:
        """All rows of several runs, as plain files: a union has no buckets of its own."""
        return self.spark.read.schema("h1 long, h2 long, n_docs long, fresh boolean").parquet(*[f"{self.path}/{run}" for run in runs])

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        remove_dir(self.spark, f"{self.path}/{run}")

    def _compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            old = self.levels.pop(level)
            self._write(level + 1, self._rows(old).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("fresh").alias("fresh")))
            for run in old:
                self._drop(run)
            level += 1

    @property
    def runs(self) -> list[str]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs) over all runs."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        return _total(self._rows(self.runs))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs) of keys in at least ``min_docs`` documents. Only keys that a later
        batch met again, or that one batch has often enough, are summed; the long tail of keys
        met in one batch alone stays where it lies."""
        if not self.runs:
            return self.counts()
        rows = self._rows(self.runs)
        may = rows.filter(~F.col("fresh") | (F.col("n_docs") >= min_docs)).select("h1", "h2").distinct()
        return _total(rows.join(may, ["h1", "h2"], "left_semi")).filter(F.col("n_docs") >= min_docs)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Keys (h1, h2) of a batch that no run holds: a merge anti-join with each run."""
        for run in self.runs:
            keys = keys.join(self.spark.table(run).filter("fresh").select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add_counts(self, counts: DataFrame) -> None:
        """Add one batch: distinct keys (h1, h2) with n_docs."""
        if self.runs:
            new = materialise(self.unseen(counts), "unseen")
            again = counts.join(new.select("h1", "h2"), ["h1", "h2"], "left_anti")
            self._write(0, new.withColumn("fresh", F.lit(True)).unionByName(again.withColumn("fresh", F.lit(False))))
            release(new)
        else:
            self._write(0, counts.withColumn("fresh", F.lit(True)))
        self._compact()

    def add(self, keys: DataFrame) -> None:
        """Add one batch: a row (h1, h2) for each document and distinct key."""
        self.add_counts(_total(keys.withColumn("n_docs", F.lit(1).cast("long"))))

    def add_batches(self, keys: DataFrame, batches: int) -> None:
        """Add ``batches`` batches, given by the column ``batch`` (0 to batches - 1), in turn. One
        pass counts them all and writes them apart."""
        staged = f"{self.path}/staged"
        counts = keys.groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        counts.write.partitionBy("batch").parquet(staged)
        table = self.spark.read.schema("h1 long, h2 long, n_docs long, batch int").parquet(staged)
        for b in range(batches):
            self.add_counts(table.filter(F.col("batch") == b).drop("batch"))
        remove_dir(self.spark, staged)

    def close(self) -> None:
        """Drop all runs."""
        for run in self.runs:
            self._drop(run)
        self.levels = {}


def _total(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def arrival(docs: DataFrame, batches: int) -> Column:
    """The batch of a document, 0 to ``batches`` - 1: documents come in order of doc_id, in
    batches of about equal size; ids that are null or no numbers come first."""
    d = docs["doc_id"].try_cast("double")
    cuts = docs.agg(F.percentile_approx(d, [i / batches for i in range(1, batches)], F.lit(1000)).alias("q")).first()["q"] if batches > 1 else None
    return F.coalesce(reduce(lambda a, b: a + b, [(d >= c).cast("int") for c in cuts or []], F.lit(0)), F.lit(0))


def document_keys(docs: DataFrame, batch: Column, min_chars: int = 1) -> DataFrame:
    """(batch, h1, h2), a row for each document and distinct key of at least ``min_chars``."""
    keys = F.filter(F.array_distinct(F.transform(lines_of(F.col("text")), line_key)), lambda k: F.length(k) >= min_chars)
    return docs.select(batch.alias("batch"), F.explode(keys).alias("key")).select("batch", *key_hashes(F.col("key")))


def _spread(frequent: DataFrame, shares: int) -> tuple[DataFrame, DataFrame]:
    """``frequent`` with a salt, and (h1, h2, parts) of its hot keys: those with more than one
    ``shares``-th of all counts, so fewer than ``shares`` keys. A hot key is dealt to as many
    parts as it holds such shares; all others have the one part 0."""
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    parts = F.ceil(F.col("n_docs") * shares / F.lit(float(max(total, 1)))).cast("int")
    rows = frequent.withColumn("parts", F.greatest(parts, F.lit(1)))
    return rows.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")), rows.filter("parts > 1").select("h1", "h2", "parts")


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1, shares: int = 10_000) -> DataFrame:
    """``docs`` with ``text`` replaced by the lines whose keys are not in ``frequent`` (h1, h2,
    n_docs), and n_lines, n_dropped added. Only hashes and positions are joined, hot ones in parts;
    texts move once, to meet the positions of their dropped lines.
    """
    key = dict(zip((_R1, _R2), row_key(docs["doc_id"], docs["text"])))
    rows = docs.withColumns(key)
    salted, hot = _spread(frequent, shares)
    marked = rows.select(_R1, _R2, F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    marked = marked.select(_R1, _R2, "pos", *key_hashes(F.col("key"))).join(F.broadcast(hot), ["h1", "h2"], "left")
    marked = marked.withColumn("salt", F.coalesce(F.pmod(F.col(_R1), F.col("parts")), F.lit(0)).cast("int"))
    hit = marked.join(salted, ["h1", "h2", "salt"], "left_semi")
    gone = hit.groupBy(_R1, _R2).agg(F.collect_set("pos").alias(_GONE))
    lines = lines_of(F.col("text"))
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(_GONE))
    rest = let(lines, lambda ls: F.array_join(F.transform(stay(ls), lambda p: ls[p]), "\n"))  # bound, else split anew for each line
    kept = F.when(F.col(_GONE).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(rest)
    return (rows.join(gone, [_R1, _R2], "left")
            .withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(_GONE), F.lit(0)).cast("long"), "text": kept})
            .drop(_R1, _R2, _GONE))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 4) -> DataFrame:
    """Remove from every document all lines whose key occurs in ``min_docs`` or more documents.

    Documents come in ``batches`` batches by doc_id (``arrival``); each is merge-anti-joined with
    the runs of those before it. Returns the columns of ``docs`` (doc_id, text needed) with the new
    text, plus n_lines and n_dropped. A document is a row: repeated rows count once each and all
    keep their rows. Null or empty text is one empty line and stays the empty text; keys shorter
    than ``min_chars`` never go; an empty table gives no rows. Further columns pass through, except
    that n_lines and n_dropped are this operator's own and replace columns of such names.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    runs = LineRuns(spark, scratch_dir(spark, "line-runs"), fanout)
    try:
        runs.add_batches(document_keys(docs.select("doc_id", "text"), arrival(docs, batches), min_chars), batches)
        frequent = materialise(runs.frequent(min_docs), "frequent-lines")
    finally:
        runs.close()
    return drop_lines(docs, frequent, min_chars)
