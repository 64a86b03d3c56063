"""Queries on records: metadata, checks, merged maps, clause and search records, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as Q
from ..functions import clauses as X
from ..functions import constants as K
from ..functions import text as T
from ..operators import chunking as C
from ..operators import clauses as L
from ..operators import search
from ..operators import state as ST
from ..operators import structure as S
from ..sources.tables import dealt, table
from .claims import _MATCH, _PARSED, _claims, _matched
from .clauses import _SEGMENTS, _first
from .profile import _T, _any, _n, _parts, _present, _strip
from .samples import CLAUSES, NL, QUESTIONS, STRUCTURED, load
from .structure import _CHUNKS, _DOCS, _HEADS, _SECTIONS, _fixed

_TEXT = "coalesce(text, '')"


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


def language_or_metadata(spark, d):
    """The language of documents; every third is taken to bring none."""
    known = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return _documents(spark, d).select("doc_id", T.language_or(known, F.col("text")).alias("language"))


#: Texts with odd spaces, quotes, dashes and line ends.
def _unruly(c):
    return F.replace(F.replace(F.replace(F.replace(c, F.lit(". "), F.lit(".\u00a0 ")), F.lit(", "), F.lit(" \u2013 ")), F.lit("\n"), F.lit("\r\n")), F.lit(" the "), F.lit(" \u201cthe\u201d "))


def normalize_changes(spark, d):
    """What normalising changes, and by how much it shortens the text in per cent."""
    rows = dealt(spark, d, "documents", "doc_id").select("doc_id", _unruly(F.coalesce("text", F.lit(""))).alias("t"))
    rows = rows.select("doc_id", F.length("t").alias("before"), T.changes(F.col("t")).alias("c")).select("doc_id", "before", F.col("c.length").alias("after"), F.col("c.counts").alias("x"))
    return rows.select("doc_id", "x.*", F.when(F.col("before") > 0, F.round((F.col("before") - F.col("after")) / F.col("before") * 100, 6)).otherwise(0.0).alias("reduction"))


def normalize_sections(spark, d):
    """A map of a text's lines by number, each value normalised."""
    rows = _documents(spark, d).select("doc_id", F.filter(F.split(_unruly(F.col("text")), "\r\n"), lambda s: s != "").alias("ls"))
    numbered = F.map_from_arrays(F.transform("ls", lambda s, i: i), F.col("ls"))
    values = F.map_values(F.transform_values(numbered, lambda k, v: T.normalise(v)))
    return rows.select("doc_id", F.size("ls").alias("n_sections"), F.sha2(F.array_join(values, "|").cast("binary"), 256).alias("sha"))


def document_links(spark, d):
    """Hyperlinks, numbered references and suspicious links of pages."""
    html = F.concat("html", F.lit(" see [12] and (7), http://bit.ly/x or http://10.0.0.1/y, https://T.CO/z"))
    links = lambda c: F.md5(F.array_join(c, "|").cast("binary"))
    return table(spark, d, "pages").select("page_id", F.size(T.hyperlinks(html)).alias("n_links"), links(T.hyperlinks(html)).alias("links_md5"), F.array_join(T.numbered_references(html), ",").alias("refs"), F.array_join(T.suspicious_links(html), " ").alias("suspicious"))


def sentence_counts(spark, d):
    return _documents(spark, d).select("doc_id", T.sentence_count(F.col("text")).alias("n_sentences"))


def duration_labels(spark, d):
    return table(spark, d, "events").select("event_id", T.duration_label(F.abs(F.col("value").cast("long")) / 4).alias("label"))


def metadata_merge(spark, d):
    """Metadata of a document and of its text as one map, and how many fields aren't empty."""
    own = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string")), lambda k, v: v.isNotNull())
    made = F.create_map(F.lit("n_chars"), F.length("text").cast("string"), F.lit("n_words"), T.word_count(F.col("text")).cast("string"))
    entries = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    both, apart = T.merged(own, made), T.merged(own, made, "made_")
    return _documents(spark, d).select("doc_id", entries(both).alias("merged"), entries(apart).alias("prefixed"), F.size(both).alias("n_fields"))


def question_checks(spark, d):
    """Faults of first turns as questions, and of the lists of turns of a conversation."""
    c = table(spark, d, "conversations").withColumn("fault", F.coalesce(T.question_fault(F.col("text")), F.lit("none")))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).between(1, 10).alias("n_allowed"), F.sum((F.col("fault") == "empty").cast("long")).alias("n_empty"), F.sum((F.col("fault") == "too_long").cast("long")).alias("n_long"), F.min_by(T.strip(F.col("text")), "turn").alias("first"))


def chunk_snapped(spark, d):
    return C.snapped(_documents(spark, d).select("doc_id", "text")).select("doc_id", "k", "start", "end", F.md5("content").alias("content_md5"))


def long_boundaries(spark, d):
    big = load(spark, d, STRUCTURED).withColumn("text", F.repeat("text", 3))
    return big.select("doc_id", F.array_join(C.long_boundaries(F.col("text"), 1500, 1200), ",").alias("boundaries"))


def chunk_coverage(spark, d):
    docs = _documents(spark, d).select("doc_id", "text")
    chunks = C.fixed(docs).withColumn("chunk_id", C.chunk_id(F.col("doc_id"), F.col("start"), F.col("content")))
    return C.coverage(docs, chunks.filter("k % 7 <> 3"))


def heading_pages(spark, d):
    """The page, of 400 characters each, on which a heading stands."""
    docs = load(spark, d, STRUCTURED)
    pages = C.fixed(docs, C.ChunkConfig(400, 20, 0)).select("doc_id", (F.col("k") + 1).alias("page"), "start", "end")
    return C.page_of(S.headings(docs).select("doc_id", "position", "title"), pages)


def section_titles(spark, d):
    return S.sections_by_title(S.sections(load(spark, d, STRUCTURED).withColumn("text", F.concat("text", F.lit("\n# Closing\nAgain")))))


def clause_sections(spark, d):
    return S.clause_sections(load(spark, d, STRUCTURED))


_DOUBLED = f"SELECT clause_id, text || {NL} || {NL} || 'Tiny part.' || {NL} || {NL} || 'The party shall pay the fee under this agreement after ' || clause_id || ' days of delay.' AS text FROM ({CLAUSES})"


def clause_records(spark, d):
    """Clauses as records: level, references, terms and the text around, 60 characters each side."""
    found = L.clauses(load(spark, d, _DOUBLED).filter("clause_id IS NOT NULL"), types=False, around=60)
    rows = found.select("clause_id", "start", X.section_level(F.col("part")).alias("level"), F.array_join(X.references(F.col("part")), "|").alias("refs"), F.size(X.key_terms(F.col("part"))).alias("n_terms"), F.md5(F.col("context").cast("binary")).alias("context_md5"))
    return rows.withColumn("record", F.to_json(F.struct("clause_id", "start", "level")))


def clauses_by_type(spark, d):
    """Clauses of one type, and by id the one clause that has it."""
    rows = load(spark, d, CLAUSES).select("clause_id", X.type_and_confidence(F.col("text"))["clause_type"].alias("clause_type"))
    return rows.filter((F.col("clause_type") == "payment") | (F.col("clause_id") == 7))


#: Each clause refers to the first of its group of sixteen.
_EDGES = f"SELECT clause_id AS src, clause_id - clause_id % 16 + 1 AS dst, CASE WHEN clause_id % 2 = 0 THEN 'refers_to' ELSE 'depends_on' END AS relation FROM ({CLAUSES}) WHERE clause_id % 16 <> 1"


def related_clauses(spark, d):
    return search.related(load(spark, d, CLAUSES).filter("clause_id % 5 <> 2"), load(spark, d, _EDGES))


def condition_compliance(spark, d):
    rows = _matched(spark, d).filter("rank <= 5")
    return rows.select("claim_id", "clause_id", Q.complies(F.col("text"), F.col("age"), F.col("location")).alias("complies"))


def claim_query_json(spark, d):
    return _claims(spark, d).select("claim_id", F.to_json(F.struct("age", "gender", "procedure", "policy_age_months")).alias("json"))


def error_json(spark, d):
    """An answer for each question: an error record for those that name no procedure."""
    failed = F.to_json(F.struct(F.lit("error").alias("decision"), F.lit("no procedure named").alias("reason"), F.lit(0).alias("confidence")))
    return _claims(spark, d).select("claim_id", F.when(F.col("procedure").isNull(), failed).otherwise(F.to_json(F.struct(F.lit("ok").alias("decision"), F.col("procedure").alias("reason")))).alias("json"))


def vector_chunks(spark, d):
    """The documents behind the ten vectors most like the first; every other one is missing."""
    v = table(spark, d, "embeddings")
    query = v.filter("vec_id = 0").select("embedding").take(1)
    found = search.top_k(v, list(query[0][0]) if query else [], 10, None)
    return search.with_chunks(found, _documents(spark, d).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "text"))


def chunk_records(spark, d):
    """Chunks as records with their section, and how they are shown with their context."""
    docs = load(spark, d, STRUCTURED)
    chunks = C.fixed(docs, C.ChunkConfig(300, 50, 50))
    shown = F.md5(C.context_label(F.col("content"), F.col("start"), F.col("end"), 100).cast("binary"))
    rows = C.with_section(chunks.select("doc_id", "start", "end", shown.alias("shown_md5")), S.sections(docs))
    return rows.select("doc_id", "start", F.to_json(F.struct("doc_id", "start", "end", "section")).alias("record"), "shown_md5")


def search_stats(spark, d):
    return ST.call_stats(table(spark, d, "events"), "event_type", F.col("value"), F.col("value") > 50).withColumns({c: F.round(c, 6) for c in ("mean", "hit_rate")})


def preprocessing_report(spark, d):
    """Whether a document may go on, what keeps it from that, and how many stand so."""
    t = F.col("text")
    tests = {"blank": T.strip(t) == "", "short": F.length(T.strip(t)) < 10, "no_source": F.col("source").isNull(), "no_language": F.col("lang").isNull(), "long": F.length(t) > 100_000}
    issues = F.array_compact(F.array(*[F.when(c, k) for k, c in tests.items()]))
    rows = _documents(spark, d).select(F.array_join(issues, ",").alias("issues"), F.length(t).alias("n"))
    return rows.groupBy("issues").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chars"), F.first(F.col("issues") == "").alias("valid"))


def document_metadata(spark, d):
    """All that is known of a document in one row, and how many of its fields aren't null."""
    t = F.col("text")
    rows = _documents(spark, d).select("doc_id", "lang", "source", F.struct(*[c.alias(k) for k, c in T.statistics(t).items()]).alias("s"), T.language(t).alias("l"), T.readability(t).alias("r"), F.struct(*[c.alias(k) for k, c in T.pattern_counts(t).items()]).alias("p"))
    rows = rows.select("doc_id", "lang", "source", "s.*", "l.*", "r.*", "p.*")
    names = [c for c in rows.columns if c != "doc_id"]
    n = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return rows.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes], n.alias("n_fields"))


QUERIES = {f.__name__: f for f in (chunk_records, search_stats, preprocessing_report, document_metadata, language_or_metadata, normalize_changes, normalize_sections, document_links, sentence_counts, duration_labels, metadata_merge, question_checks, chunk_snapped, long_boundaries, chunk_coverage, heading_pages, section_titles, clause_sections, clause_records, clauses_by_type, related_clauses, condition_compliance, claim_query_json, error_json, vector_chunks)}


def _chars(cs):
    return "[" + cs + "]"


_U = f"replace(replace(replace(replace({_TEXT}, '. ', '.' || chr(160) || ' '), ', ', ' ' || chr(8211) || ' '), chr(10), chr(13) || chr(10)), ' the ', ' ' || chr(8220) || 'the' || chr(8221) || ' ')"


def _normal(x):
    for p, to in ((r"\r\n?", "chr(10)"), (_chars(K.UNICODE_SPACES), "' '"), (" {2,}", "' '"), (_chars(K.DOUBLE_QUOTES), "chr(34)"), (_chars(K.SINGLE_QUOTES), "chr(39)"), (_chars(K.DASHES), "'-'")):
        x = f"regexp_replace({x}, '{p}', {to}, 'g')"
    return x


_SPACED = f"regexp_replace(regexp_replace(u, '\\r\\n?', chr(10), 'g'), '{_chars(K.UNICODE_SPACES)}', ' ', 'g')"
_SHORT = [_present("p", [f" {w} " for w in ws]) for ws in (K.ENGLISH_WORDS_SHORT, K.SPANISH_WORDS_SHORT, K.FRENCH_WORDS_SHORT)]
_HTML = "html || ' see [12] and (7), http://bit.ly/x or http://10.0.0.1/y, https://T.CO/z'"
_LINKS = f"regexp_extract_all(h, '{K.URL}')"
_SHORTENED = " OR ".join(f"contains(lower(u), '{s}')" for s in K.SHORTENERS)
_ENTRIES = "array_to_string(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), '|')"
_NUM = _first(_strip("title"), K.NUMBERINGS)
_STRUCT_DOC = f"SELECT doc_id, text || {NL} || '# Closing' || {NL} || 'Again' AS text FROM ({STRUCTURED})"
_AGE_LIMIT = r"TRY_CAST(nullif(regexp_extract(lower(text), 'age[^\n]*?(\d+)', 1), '') AS INT)"
_REFS = "array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(part, '{p}', {g})" for p, g in K.REFERENCES) + "]))), '|')"
_N_TERMS = "len(list_distinct(flatten([" + ", ".join([f"regexp_extract_all(lower(part), '{p}')" for p in K.KEY_TERMS] + ["""regexp_extract_all(part, '"([^"]+)"', 1)""", r"regexp_extract_all(part, '\b[A-Z][A-Z\s]{2,}\b')"]) + "])))"


def _level(t):
    n = _first(_strip(t), K.NUMBERINGS)
    has = lambda *ws: " OR ".join(f"contains(lower({t}), '{w}')" for w in ws)
    return f"CASE WHEN {n} IS NOT NULL THEN length({n}) - length(replace({n}, '.', '')) + 1 WHEN {has('article', 'chapter', 'part')} THEN 1 WHEN {has('section')} THEN 2 WHEN {has('clause')} THEN 3 ELSE 4 END"


def _sql():
    from .clauses import _BEST, _TYPE, _likely, _structure
    from .profile import SQL as PROFILE_SQL
    from .structure import SQL as STRUCTURE_SQL

    boundaries = lambda t: f"list_filter(list_transform(range(1, len(string_split({t}, chr(10) || chr(10))) + 1), lambda i: CAST(list_sum(list_transform(string_split({t}, chr(10) || chr(10))[1:i], lambda p: length(p) + 2)) AS BIGINT)), lambda b: b < length({t}))"
    parts = _SEGMENTS.replace("p AS text,", "p AS part,")
    meta = ["lang", "source", "n_chars", "n_words", "n_sentences", "n_paragraphs", "n_lines", "words_per_sentence", "words_per_paragraph", "language", "indicators", "confidence", "flesch", "reading_level", *K.CONTENT_PATTERNS]
    return {
        "chunk_records": f"""SELECT c.doc_id, c.start, '{{"doc_id":' || c.doc_id || ',"start":' || c.start || ',"end":' || c."end" || CASE WHEN s.section IS NOT NULL THEN ',"section":"' || s.section || '"' ELSE '' END || '}}' AS record, md5('[Context: ' || greatest(c.start - 100, 0) || '-' || (c."end" + 100) || '] ' || c.content) AS shown_md5
            FROM ({_fixed(STRUCTURED, 300, 50)}) c JOIN ({STRUCTURE_SQL['chunk_section_range_join']}) s ON s.doc_id = c.doc_id AND s.start = c.start""",
        "search_stats": "SELECT event_type, count(*) AS n, sum(value) AS total, round(avg(value), 6) AS mean, round(count(*) FILTER (WHERE value > 50)::DOUBLE / count(*), 6) AS hit_rate FROM events GROUP BY event_type",
        "preprocessing_report": f"""SELECT issues, count(*) AS n_documents, sum(length(t)) AS n_chars, issues = '' AS valid FROM (SELECT t, array_to_string(list_filter([CASE WHEN {_strip('t')} = '' THEN 'blank' END, CASE WHEN length({_strip('t')}) < 10 THEN 'short' END, CASE WHEN source IS NULL THEN 'no_source' END,
            CASE WHEN lang IS NULL THEN 'no_language' END, CASE WHEN length(t) > 100000 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT *, {_TEXT} AS t FROM documents)) GROUP BY issues""",
        "document_metadata": f"""SELECT *, {' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in meta)} AS n_fields FROM (SELECT doc_id, lang, source FROM documents) JOIN ({PROFILE_SQL['text_stats']}) USING (doc_id) JOIN ({PROFILE_SQL['language']}) USING (doc_id) JOIN ({PROFILE_SQL['readability']}) USING (doc_id) JOIN ({PROFILE_SQL['pattern_counts']}) USING (doc_id)""",
        "language_or_metadata": f"SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN lang END, CASE WHEN en >= es AND en >= fr THEN 'english' WHEN es >= fr THEN 'spanish' WHEN fr > 0 THEN 'french' ELSE 'unknown' END) AS language FROM (SELECT *, {_SHORT[0]} AS en, {_SHORT[1]} AS es, {_SHORT[2]} AS fr FROM (SELECT *, ' ' || lower({_TEXT}) || ' ' AS p FROM documents))",
        "normalize_changes": f"""SELECT doc_id, 0 AS control_characters, {_n('u', r'\r\n?')} AS line_endings, {_n('u', _chars(K.UNICODE_SPACES))} AS white_space, length({_SPACED}) - length(regexp_replace({_SPACED}, ' {{2,}}', ' ', 'g')) AS extra_spaces, {_n('u', _chars(K.DOUBLE_QUOTES + K.SINGLE_QUOTES))} AS quotes, {_n('u', _chars(K.DASHES))} AS dashes,
            CASE WHEN length(u) > 0 THEN round((length(u) - length({_normal('u')}))::DOUBLE / length(u) * 100, 6) ELSE 0 END AS reduction FROM (SELECT doc_id, {_U} AS u FROM documents)""",
        "normalize_sections": f"SELECT doc_id, len(ls) AS n_sections, sha256(array_to_string(list_transform(ls, lambda s: {_normal('s')}), '|')) AS sha FROM (SELECT doc_id, list_filter(string_split({_U}, chr(13) || chr(10)), lambda s: s <> '') AS ls FROM documents)",
        "document_links": rf"""SELECT page_id, len({_LINKS}) AS n_links, md5(array_to_string({_LINKS}, '|')) AS links_md5, array_to_string(list_transform(regexp_extract_all(h, '\[\d+\]|\(\d+\)'), lambda r: r[2:-2]), ',') AS refs,
            array_to_string(list_filter({_LINKS}, lambda u: {_SHORTENED} OR regexp_matches(u, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')), ' ') AS suspicious FROM (SELECT page_id, {_HTML} AS h FROM pages)""",
        "sentence_counts": f"SELECT doc_id, len(list_filter(string_split_regex({_TEXT}, '[.!?]+'), lambda p: {_strip('p')} <> '')) AS n_sentences FROM documents",
        "duration_labels": "SELECT event_id, CASE WHEN s < 1 THEN CAST(round(s * 1000) AS BIGINT) || 'ms' WHEN s < 60 THEN format('{:.1f}', round(s, 1)) || 's' ELSE CAST(floor(s / 60) AS BIGINT) || 'm ' || format('{:.1f}', round(s % 60, 1)) || 's' END AS label FROM (SELECT event_id, abs(CAST(trunc(value) AS BIGINT)) / 4.0::DOUBLE AS s FROM events)",
        "metadata_merge": f"""SELECT doc_id, {_ENTRIES.format("'lang=' || lang, 'source=' || source, 'n_chars=' || length(t), 'n_words=' || w")} AS merged, {_ENTRIES.format("'lang=' || lang, 'source=' || source, 'n_chars=' || n_chars, 'made_n_chars=' || length(t), 'made_n_words=' || w")} AS prefixed,
            2 + CAST(lang IS NOT NULL AS INT) + CAST(source IS NOT NULL AS INT) AS n_fields FROM (SELECT *, {_TEXT} AS t, {_n(_T, r'[^ \t\n\r\f]+')} AS w FROM documents)""",
        "question_checks": f"SELECT conv_id, count(*) BETWEEN 1 AND 10 AS n_allowed, count(*) FILTER (WHERE coalesce({_strip('text')}, '') = '') AS n_empty, count(*) FILTER (WHERE coalesce({_strip('text')}, '') <> '' AND length(text) > 500) AS n_long, min_by({_strip('text')}, turn) AS first FROM conversations GROUP BY conv_id",
        "chunk_snapped": rf"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM ({_DOCS}) WHERE {_strip('text')} <> ''),
            r AS (SELECT doc_id, -1 AS k, 0::BIGINT AS s, 50::BIGINT AS e FROM d
            UNION ALL SELECT doc_id, k + 1, e - 50, CASE WHEN f >= n THEN n WHEN l > 0 THEN f - 200 + l ELSE f END FROM (SELECT *, length(regexp_extract(substr(text, f - 199, 201), '(?s)^(.*[.!?])\s', 1)) AS l FROM (SELECT r.*, d.text, d.n, least(r.e - 50 + 1000, d.n) AS f FROM r JOIN d USING (doc_id) WHERE r.e < d.n OR r.k = -1)))
            SELECT doc_id, k, s AS start, e AS "end", md5(substr(text, s + 1, e - s)) AS content_md5 FROM r JOIN d USING (doc_id) WHERE k >= 0""",
        "long_boundaries": f"SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list_transform(range(0, length(t), 1200), lambda s: list_transform({boundaries('substr(t, s + 1, 1500)')}, lambda b: b + s))))), ',') AS boundaries FROM (SELECT doc_id, repeat(text, 3) AS t FROM ({STRUCTURED}))",
        "chunk_coverage": f"""SELECT d.doc_id, coalesce(m = u, TRUE) AS unique_ids, round(CASE WHEN length(d.text) > 0 THEN coalesce(n, 0)::DOUBLE / length(d.text) ELSE 1 END, 6) AS share, CASE WHEN length(d.text) > 0 THEN coalesce(n, 0)::DOUBLE / length(d.text) ELSE 1 END >= 0.8 AS covered
            FROM ({_DOCS}) d LEFT JOIN (SELECT doc_id, sum(length(content)) AS n, count(*) AS m, count(DISTINCT chunk_id) AS u FROM ({_CHUNKS}) WHERE k % 7 <> 3 GROUP BY doc_id) c USING (doc_id)""",
        "heading_pages": f"""SELECT h.doc_id, h.position, h.title, p.k + 1 AS page FROM ({_HEADS}) h LEFT JOIN ({_fixed(STRUCTURED, 400, 0)}) p ON p.doc_id = h.doc_id AND h.position >= p.start AND h.position < p."end" """,
        "section_titles": f"""SELECT doc_id, title, max_by(level, start) AS level, max(start) AS start, max_by("end", start) AS "end", max_by({_n('substr(text, start + 1, "end" - start)', r'[^ \t\n\r\f]+')}, start) AS n_words FROM ({_SECTIONS.replace(STRUCTURED, _STRUCT_DOC)}) GROUP BY doc_id, title""",
        "clause_sections": f"SELECT * FROM (SELECT doc_id, line_number, title, {_structure('title')} AS structure_type, {_NUM} AS number, {_level('title')} AS level FROM (SELECT doc_id, line_number, {_strip('raw')} AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_number FROM ({STRUCTURED}))) WHERE title <> '') WHERE structure_type IN ('section', 'article', 'heading')",
        "clause_records": f"""SELECT *, '{{"clause_id":' || clause_id || ',"start":' || start || ',"level":' || level || '}}' AS record FROM (SELECT s.clause_id, CAST(start AS BIGINT) AS start, {_level('part')} AS level, {_REFS} AS refs, {_N_TERMS} AS n_terms, md5(substr(d.text, CAST(greatest(start - 60, 0) AS BIGINT) + 1, CAST(start + length(part) + 60 - greatest(start - 60, 0) AS BIGINT))) AS context_md5
            FROM ({parts}) s JOIN ({_DOUBLED}) d USING (clause_id) WHERE length(part) > 50 AND {_likely('part')})""",
        "clauses_by_type": f"SELECT clause_id, {_TYPE} AS clause_type FROM ({_BEST} ({CLAUSES})) WHERE {_TYPE} = 'payment' OR clause_id = 7",
        "related_clauses": f"""WITH c AS (SELECT clause_id FROM ({CLAUSES}) WHERE clause_id % 5 <> 2), e AS ({_EDGES}) SELECT * FROM (SELECT src AS clause_id, dst AS related_id, relation, 'to' AS direction FROM e UNION ALL SELECT dst, src, relation, 'from' FROM e) WHERE clause_id IN (SELECT clause_id FROM c) AND related_id IN (SELECT clause_id FROM c)""",
        "condition_compliance": f"""SELECT claim_id, clause_id, CASE WHEN {_AGE_LIMIT} IS NOT NULL AND coalesce(age, 0) <> 0 AND (contains(lower(text), 'above') OR contains(lower(text), 'over')) THEN age > {_AGE_LIMIT} WHEN {_AGE_LIMIT} IS NOT NULL AND coalesce(age, 0) <> 0 AND (contains(lower(text), 'below') OR contains(lower(text), 'under')) THEN age < {_AGE_LIMIT}
            WHEN location IS NOT NULL AND contains(lower(text), 'network') THEN lower(location) IN ({', '.join(f"'{c}'" for c in K.NETWORK_CITIES)}) ELSE TRUE END AS complies FROM ({_MATCH}) WHERE rank <= 5""",
        "claim_query_json": f"""SELECT claim_id, '{{' || array_to_string(list_filter(['"age":' || age, '"gender":"' || gender || '"', '"procedure":"' || procedure || '"', '"policy_age_months":' || policy_age_months], lambda x: x IS NOT NULL), ',') || '}}' AS json FROM ({_PARSED})""",
        "error_json": f"""SELECT claim_id, CASE WHEN procedure IS NULL THEN '{{"decision":"error","reason":"no procedure named","confidence":0}}' ELSE '{{"decision":"ok","reason":"' || procedure || '"}}' END AS json FROM ({_PARSED})""",
        "vector_chunks": f"""SELECT row_number() OVER (ORDER BY s DESC, vec_id) AS rank, coalesce(CAST(doc_id AS VARCHAR), 'unknown_' || vec_id) AS chunk, round(s, 3) AS score, coalesce(left({_TEXT}, 200), '') AS text FROM (
            SELECT v.vec_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS s FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, vec_id LIMIT 10) LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) ON doc_id = vec_id""",
    }


SQL = _sql()
