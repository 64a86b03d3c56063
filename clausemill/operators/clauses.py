"""Clauses of documents: parts between blank lines that read like clauses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import clauses as X
from ..sources import scratch

_BLANK = " \t\n\r\f\x0b"


def parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The stripped parts between blank lines, the row of each one's text, and its running position
    there, which counts two characters for each separator: a difference of running sums."""
    lists = pc.split_pattern(texts, "\n\n")
    found = pc.utf8_trim(pc.list_flatten(lists), _BLANK)
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    of, first = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many
    ends = np.cumsum(pc.utf8_length(found).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    before = np.concatenate([[0], ends[:-1]])[:len(ends)]
    return found, of, before - before[first[of]]


def _around(texts: pa.Array, of: np.ndarray, start: np.ndarray, found: pa.Array, around: int) -> pa.Array:
    """Spans of texts from ``around`` characters before each start to as many after its part's end."""
    whole, ends = texts.to_pylist(), start + pc.utf8_length(found).to_numpy(zero_copy_only=False)
    return pa.array([whole[i][max(a - around, 0):b + around] for i, a, b in zip(of.tolist(), start.tolist(), ends.tolist())], pa.string())


def clauses(docs: DataFrame, least: int = 50, types: bool = True, around: int | None = None) -> DataFrame:
    """(clause_id, start, part) of the parts of ``docs`` (clause_id, text) that are longer than
    ``least`` and likely clauses; on demand their clause_type, and as context the text with
    ``around`` characters on either side. Rows that share a clause_id are cut each by itself; null
    texts have no parts. Texts are cut and matched in Arrow batches where they lie, without a
    shuffle, a sort or a join."""
    scratch.bound_batches(docs.sparkSession)
    docs = docs.filter("text IS NOT NULL").select("clause_id", "text")
    more = [T.StructField(n, T.StringType()) for n, on in (("clause_type", types), ("context", around is not None)) if on]
    schema = T.StructType([docs.schema["clause_id"], T.StructField("start", T.LongType()), T.StructField("part", T.StringType()), *more])

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found, of, start = parts(texts)
            for test in (lambda p: pc.greater(pc.utf8_length(p), least), X.reads_like_clause):
                kept = test(found)
                mask = kept.to_numpy(zero_copy_only=False).astype(bool)
                found, of, start = found.filter(kept), of[mask], start[mask]
            columns = [batch.column("clause_id").take(pa.array(of)), pa.array(start), found]
            if types:
                columns.append(X.types_of(found).field("clause_type"))
            if around is not None:
                columns.append(_around(texts, of, start, found, around))
            yield pa.record_batch(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
