"""Preprocessing in one pass, with figures of each stage taken on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from .chunking import ChunkConfig, fixed


class Stages:
    """Figures of a job's stages. ``watch`` gives a frame that counts what passes it; when an action
    has run over the last one, ``report`` has the figures of that run, without another scan."""

    def __init__(self):
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, rows: DataFrame, stage: str, **figures: Column) -> DataFrame:
        if stage in dict(self._seen):
            raise ValueError(f"two stages are called {stage}")
        self._seen.append((stage, seen := Observation(stage)))
        return rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in figures.items()])

    def figures(self) -> dict[str, dict]:
        return {stage: seen.get for stage, seen in self._seen}

    def report(self, rows: DataFrame) -> DataFrame:
        """(place, stage, figure, value) of all stages; a figure of no rows is null."""
        found = [(i, s, k, None if v is None else float(v)) for i, (s, f) in enumerate(self.figures().items()) for k, v in f.items()]
        return rows.sparkSession.createDataFrame(found, "place int, stage string, figure string, value double")


def preprocess(docs: DataFrame, stages: Stages, c: ChunkConfig = ChunkConfig(), least: int = 10) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text): texts under ``least`` characters go, the rest is normalised
    and cut. Null texts count as empty."""
    length = F.length("text")
    read = stages.watch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "read", n_chars=F.sum(length), n_blank=F.sum((X.strip(F.col("text")) == "").cast("long")))
    valid = stages.watch(read.filter(F.length(X.strip(F.col("text"))) >= least), "valid", n_chars=F.sum(length))
    clean = X.with_nfc(valid.withColumn("_before", length).withColumn("_old", F.xxhash64("text")).withColumn("text", X.normalise(F.col("text"))))
    clean = stages.watch(clean, "normalised", n_chars_before=F.sum("_before"), n_chars=F.sum(length), n_changed=F.sum((F.xxhash64("text") != F.col("_old")).cast("long")))
    size = F.length("content")
    return stages.watch(fixed(clean.select("doc_id", "text"), c), "chunked", n_chars=F.sum(size), smallest=F.min(size), largest=F.max(size), n_small=F.sum((size < c.min_size).cast("long")))


def summary(figures: dict[str, dict], batch: int = 32) -> dict:
    """What a run came to: completed stages, documents kept, the reduction of their texts in percent,
    chunks, and the mean size of batches of at most ``batch`` chunks."""
    read, valid, clean, chunks = (figures[k] for k in ("read", "valid", "normalised", "chunked"))
    before, after = clean["n_chars_before"] or 0, clean["n_chars"] or 0
    batches = -(-chunks["n"] // batch)
    return {"stages_completed": len(figures), "n_documents": read["n"], "n_kept": valid["n"], "reduction_percent": round(100 * (before - after) / before, 6) if before else 0.0, "n_changed": clean["n_changed"] or 0, "n_chunks": chunks["n"], "mean_batch": chunks["n"] / batches if batches else 0.0}


def faults(figures: dict[str, dict]) -> list[str]:
    """What is wrong with a run; nothing if it may be used."""
    s, chunks = summary(figures), figures["chunked"]
    found = {"nothing_read": s["n_documents"] == 0, "nothing_kept": s["n_documents"] > 0 and s["n_kept"] == 0, "most_rejected": 0 < s["n_kept"] < s["n_documents"] / 2, "half_of_text_lost": s["reduction_percent"] > 50, "text_grew": s["reduction_percent"] < 0,
             "chunks_missing": s["n_kept"] > 0 and s["n_chunks"] < s["n_kept"], "characters_missing": (chunks["n_chars"] or 0) < (figures["normalised"]["n_chars"] or 0)}
    return [k for k, bad in found.items() if bad]
