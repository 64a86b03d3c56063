"""A preprocessing run over ``documents`` and the figures that it took on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocess as P
from ..sources import scratch
from ..sources.tables import dealt
from .profile import _TEXT_UNRULY
from .profile import SQL as PROFILE_SQL


def _run(spark, d):
    t = F.coalesce("text", F.lit(""))
    unruly = F.replace(F.replace(F.replace(F.replace(t, F.lit(". "), F.lit(".  ")), F.lit(", "), F.lit(" – ")), F.lit("\n"), F.lit("\r\n")), F.lit(" the "), F.lit(" “the” "))
    stages = P.Stages()
    chunks = P.preprocess(dealt(spark, d, "documents", "doc_id").select("doc_id", unruly.alias("text")), stages)
    return stages, scratch.written(chunks, "chunks")


def preprocessing_stages(spark, d):
    """Figures of each stage, from the pass that wrote the chunks."""
    stages, chunks = _run(spark, d)
    return stages.report(chunks)


def preprocessing_summary(spark, d):
    stages, chunks = _run(spark, d)
    s = P.summary(stages.figures())
    return spark.createDataFrame([(*[s[k] for k in ("stages_completed", "n_documents", "n_kept", "reduction_percent", "n_changed", "n_chunks", "mean_batch")], ",".join(P.faults(stages.figures())))], "stages_completed int, n_documents long, n_kept long, reduction_percent double, n_changed long, n_chunks long, mean_batch double, faults string")


QUERIES = {f.__name__: f for f in (preprocessing_stages, preprocessing_summary)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ALL = f"""WITH u AS (SELECT doc_id, before, after, sha FROM ({PROFILE_SQL['normalize']})), t AS (SELECT doc_id, {_TEXT_UNRULY} AS x FROM documents),
    d AS (SELECT doc_id, before, after, sha, sha256(x) AS old, length(trim(x, {_BLANK})) AS s FROM u JOIN t USING (doc_id)), v AS (SELECT *, CASE WHEN after <= 1000 THEN 1 ELSE ceil((after - 1000) / 950.0::DOUBLE)::BIGINT + 1 END AS k FROM d WHERE s >= 10)"""
SQL = {
    "preprocessing_stages": f"""{_ALL}, c AS (SELECT v.*, i, least(1000, after - i * 950) AS size FROM v, unnest(range(k)) g(i)),
        r AS (SELECT 0 AS place, 'read' AS stage, 'n' AS figure, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 0, 'read', 'n_chars', sum(before) FROM d UNION ALL SELECT 0, 'read', 'n_blank', count(*) FILTER (WHERE s = 0) FROM d
        UNION ALL SELECT 1, 'valid', 'n', count(*) FROM v UNION ALL SELECT 1, 'valid', 'n_chars', sum(before) FROM v
        UNION ALL SELECT 2, 'normalised', 'n', count(*) FROM v UNION ALL SELECT 2, 'normalised', 'n_chars_before', sum(before) FROM v UNION ALL SELECT 2, 'normalised', 'n_chars', sum(after) FROM v UNION ALL SELECT 2, 'normalised', 'n_changed', count(*) FILTER (WHERE sha <> old) FROM v
        UNION ALL SELECT 3, 'chunked', 'n', count(*) FROM c UNION ALL SELECT 3, 'chunked', 'n_chars', sum(size) FROM c UNION ALL SELECT 3, 'chunked', 'smallest', min(size) FROM c UNION ALL SELECT 3, 'chunked', 'largest', max(size) FROM c UNION ALL SELECT 3, 'chunked', 'n_small', count(*) FILTER (WHERE size < 100) FROM c)
        SELECT place, stage, figure, value::DOUBLE AS value FROM r""",
    "preprocessing_summary": f"""{_ALL} SELECT 4 AS stages_completed, (SELECT count(*) FROM d) AS n_documents, count(*) AS n_kept, round(100.0::DOUBLE * (sum(before) - sum(after)) / sum(before), 6) AS reduction_percent, count(*) FILTER (WHERE sha <> old) AS n_changed, sum(k)::BIGINT AS n_chunks,
        sum(k) / ceil(sum(k) / 32.0::DOUBLE) AS mean_batch, '' AS faults FROM v""",
}
