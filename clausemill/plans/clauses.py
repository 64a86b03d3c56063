"""Clause queries over texts made from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clauses as X
from ..functions import constants as K
from ..operators import clauses as C
from .profile import _any, _n, _strip
from .samples import CLAUSES, NL, load


def T():
    return F.col("text")
#: Three parts a document, one of them too short.
_PARTED = f"SELECT clause_id, text || {NL} || {NL} || 'Tiny part.' || {NL} || {NL} || 'The party shall pay the fee under this agreement after ' || clause_id || ' days of delay.' AS text FROM ({CLAUSES})"


def _rows(spark, d, cols):
    rows = load(spark, d, CLAUSES).select("clause_id", *[c.alias(k) for k, c in cols.items()])
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def clause_type(spark, d):
    rows = load(spark, d, CLAUSES).select("clause_id", X.type_and_confidence(T()).alias("x"))
    return rows.select("clause_id", "x.clause_type", F.round("x.confidence", 6).alias("confidence"))


def structure_type(spark, d):
    return _rows(spark, d, {"structure_type": X.structure_type(T())})


def numbering(spark, d):
    return _rows(spark, d, {"number": X.numbering(T()), "rest": X.numbered_rest(T())})


def clause_refs(spark, d):
    return _rows(spark, d, {"refs": F.array_join(X.references(T()), "|")})


def key_terms(spark, d):
    return _rows(spark, d, {"terms": F.array_join(X.key_terms(T()), "|")})


def likely_clause(spark, d):
    return _rows(spark, d, {"likely": X.likely_clause(T())})


def clauses(spark, d):
    rows = C.clauses(load(spark, d, _PARTED))
    ident = F.concat_ws("_", F.col("clause_id").cast("string"), F.lit("clause"), F.col("start").cast("string"), F.substring(F.md5("part"), 1, 8))
    return rows.select("clause_id", "start", ident.alias("id"), "clause_type", X.structure_type(F.col("part")).alias("structure_type"))


def clauses_from_chunks(spark, d):
    """Windows of 120 characters that are likely clauses, with their type."""
    from ..operators.chunking import ChunkConfig, fixed

    chunks = fixed(load(spark, d, _PARTED).withColumnRenamed("clause_id", "doc_id"), ChunkConfig(120, 20, 20)).filter(X.likely_clause(F.col("content")))
    return chunks.select("doc_id", "start", X.type_and_confidence(F.col("content"))["clause_type"].alias("clause_type"))


def clause_type_dist(spark, d):
    return clause_type(spark, d).groupBy("clause_type").agg(F.count(F.lit(1)).alias("n"))


#: What a language model might answer for a clause; every seventh answer is no JSON.
_ANSWERS = "SELECT clause_id, text, CASE WHEN clause_id % 7 = 3 THEN 'no idea' ELSE 'Here: {\"clause_type\": \"' || CASE WHEN clause_id % 3 = 0 THEN 'other' ELSE 'liability' END || '\", \"confidence\": 0.' || (clause_id % 9 + 1) || ', \"key_terms\": [\"loss\", \"t' || (clause_id % 4) || '\"]} end' END AS response FROM (" + CLAUSES + ")"
_ANSWER = "struct<clause_type: string, confidence: double, key_terms: array<string>>"


def parse_answer(response):
    """The first JSON object of a free-text answer; type other at 0.3 where there is none."""
    got = F.from_json(F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit("")), _ANSWER)
    return F.coalesce(got, F.struct(F.lit("other").alias("clause_type"), F.lit(0.3).alias("confidence"), F.expr("cast(array() AS array<string>)").alias("key_terms")))


def llm_json_parse(spark, d):
    a = parse_answer(F.col("response"))
    return load(spark, d, _ANSWERS).select("clause_id", a["clause_type"].alias("clause_type"), a["confidence"].alias("confidence"), F.array_join(a["key_terms"], "|").alias("terms"))


def clause_llm_merge(spark, d):
    """The answer's type unless it is other, the union of terms, the mean confidence."""
    rows = load(spark, d, _ANSWERS).select("clause_id", X.type_and_confidence(T()).alias("own"), X.key_terms(T()).alias("k"), parse_answer(F.col("response")).alias("a"))
    return rows.select("clause_id", F.when(F.col("a.clause_type") != "other", F.col("a.clause_type")).otherwise(F.col("own.clause_type")).alias("clause_type"), F.round((F.col("own.confidence") + F.col("a.confidence")) / 2, 6).alias("confidence"), F.array_join(F.array_sort(F.array_union("k", "a.key_terms")), "|").alias("terms"))


QUERIES = {f.__name__: f for f in (clause_type, structure_type, numbering, clause_refs, key_terms, likely_clause, clauses, clauses_from_chunks, clause_type_dist, llm_json_parse, clause_llm_merge)}


def _q(s):
    return s.replace("'", "''")


def _typed(text):
    """SQL for the best type's struct of a text."""
    kinds = ", ".join(f"struct_pack(score := ({' + '.join(_n(f'lower({text})', p) for p in ps)})::DOUBLE / (length({text}) / 1000.0::DOUBLE + 1), ord := {-i}, type := '{k}')" for i, (k, ps) in enumerate(K.CLAUSE_INDICATORS.items()))
    return f"list_sort([{kinds}])[-1]"


def _first(text, patterns, group=1):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{_q(p)}', {group}), '')" for p in patterns) + ")"


def _set(lists):
    return f"array_to_string(list_sort(list_distinct(flatten([{', '.join(lists)}]))), '|')"


def _structure(t):
    n, rest = _first(_strip(t), K.NUMBERINGS), f"trim({_first(_strip(t), K.NUMBERINGS, 2)})"
    low = f"lower({_strip(t)})"
    return (f"CASE {' '.join(f'WHEN regexp_matches({t}, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, p in K.STRUCTURES)} WHEN regexp_matches({low}, '^(whereas|recital)') THEN 'recital' WHEN starts_with({low}, 'preamble') THEN 'preamble' "
            f"WHEN contains({low}, 'signature') AND (contains({low}, 'date') OR contains({low}, 'sign')) THEN 'signature_block' WHEN regexp_matches({low}, '^(schedule|appendix|exhibit)') THEN 'schedule' "
            f"WHEN {n} IS NOT NULL AND len(string_split({n}, '.')) > 2 THEN 'subclause' WHEN {n} IS NOT NULL AND len(string_split({n}, '.')) > 1 THEN 'clause' WHEN {n} IS NOT NULL AND length({rest}) > 200 THEN 'section' WHEN {n} IS NOT NULL THEN 'subsection' "
            f"WHEN length({t}) < 100 THEN 'heading' WHEN length({t}) < 500 THEN 'paragraph' ELSE 'section' END")


def _likely(t):
    hits = " + ".join(f"CAST(regexp_matches(lower({t}), '{p}') AS INT)" for p in K.LIKELY_CLAUSE)
    return f"({hits} >= 2 AND length({t}) BETWEEN 50 AND 2000)"


_BEST = f"SELECT *, {_typed('text')} AS b FROM"
_TYPE = "CASE WHEN b.score > 0 THEN b.type ELSE 'other' END"
_CONF = "CASE WHEN b.score > 0 THEN least(b.score, 1.0) ELSE 0.5 END"
_TERM_LISTS = [f"regexp_extract_all(lower(text), '{p}')" for p in K.KEY_TERMS] + ["""regexp_extract_all(text, '"([^"]+)"', 1)""", r"regexp_extract_all(text, '\b[A-Z][A-Z\s]{2,}\b')"]
_JSON = "nullif(regexp_extract(response, '(?s)\\{.*\\}', 0), '')"
_ANSWER_SQL = f"SELECT *, coalesce(json_extract_string(j, '$.clause_type'), 'other') AS a_type, coalesce(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.3) AS a_conf, coalesce(from_json(json_extract(j, '$.key_terms'), '[\"VARCHAR\"]'), []) AS a_terms FROM (SELECT *, CAST({_JSON} AS JSON) AS j FROM ({_ANSWERS}))"
_SEGMENTS = f"""SELECT clause_id, i, p AS text, coalesce(sum(length(p) + 2) OVER (PARTITION BY clause_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT clause_id, {_strip('q')} AS p, i FROM (SELECT clause_id, unnest(string_split(text, chr(10) || chr(10))) AS q, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM ({_PARTED})))"""
_WINDOWS = f"""SELECT clause_id AS doc_id, k * 100 AS start, substr(text, k * 100 + 1, 120) AS text FROM (SELECT clause_id, text, unnest(range(0, CASE WHEN length(text) <= 120 THEN 1 ELSE CAST(ceil((length(text) - 120) / 100.0) AS BIGINT) + 1 END)) AS k FROM ({_PARTED}))"""
SQL = {
    "clause_type": f"SELECT clause_id, {_TYPE} AS clause_type, round({_CONF}, 6) AS confidence FROM ({_BEST} ({CLAUSES}))",
    "structure_type": f"SELECT clause_id, {_structure('text')} AS structure_type FROM ({CLAUSES})",
    "numbering": f"SELECT clause_id, {_first(_strip('text'), K.NUMBERINGS)} AS number, trim({_first(_strip('text'), K.NUMBERINGS, 2)}) AS rest FROM ({CLAUSES})",
    "clause_refs": f"SELECT clause_id, {_set([f'regexp_extract_all(text, {chr(39)}{p}{chr(39)}, {g})' for p, g in K.REFERENCES])} AS refs FROM ({CLAUSES})",
    "key_terms": f"SELECT clause_id, {_set(_TERM_LISTS)} AS terms FROM ({CLAUSES})",
    "likely_clause": f"SELECT clause_id, {_likely('text')} AS likely FROM ({CLAUSES})",
    "clauses": f"SELECT clause_id, start, clause_id || '_clause_' || start || '_' || substr(md5(text), 1, 8) AS id, {_TYPE} AS clause_type, {_structure('text')} AS structure_type FROM ({_BEST} ({_SEGMENTS})) WHERE length(text) > 50 AND {_likely('text')}",
    "clauses_from_chunks": f"SELECT doc_id, start, {_TYPE} AS clause_type FROM ({_BEST} ({_WINDOWS})) WHERE {_likely('text')}",
    "clause_type_dist": f"SELECT {_TYPE} AS clause_type, count(*) AS n FROM ({_BEST} ({CLAUSES})) GROUP BY 1",
    "llm_json_parse": f"SELECT clause_id, a_type AS clause_type, a_conf AS confidence, array_to_string(a_terms, '|') AS terms FROM ({_ANSWER_SQL})",
    "clause_llm_merge": f"SELECT clause_id, CASE WHEN a_type <> 'other' THEN a_type ELSE {_TYPE} END AS clause_type, round(({_CONF} + a_conf) / 2, 6) AS confidence, array_to_string(list_sort(list_distinct(list_concat(flatten([{', '.join(_TERM_LISTS)}]), a_terms))), '|') AS terms FROM ({_BEST} ({_ANSWER_SQL}))",
}
