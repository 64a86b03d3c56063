"""Structure and chunk queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import chunking as C
from ..operators import structure as S
from ..sources.tables import dealt, table
from .profile import _T, _n, _strip
from .samples import PAGED, STRUCTURED, load


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def headings(spark, d):
    return S.headings(load(spark, d, STRUCTURED))


def paragraphs(spark, d):
    return S.paragraphs(load(spark, d, STRUCTURED)).select("doc_id", "i", "start", "end", "n_words", F.md5("content").alias("content_md5"))


def list_runs(spark, d):
    return S.list_runs(load(spark, d, STRUCTURED))


def table_runs(spark, d):
    return S.table_runs(load(spark, d, STRUCTURED))


def document_tables(spark, d):
    return S.table_runs(_docs(spark, d))


def sections(spark, d):
    return S.sections(load(spark, d, STRUCTURED))


def pdf_headings(spark, d):
    return S.page_headings(load(spark, d, STRUCTURED))


def table_heuristic(spark, d):
    return _docs(spark, d).select("doc_id", S.looks_tabular(F.col("text")).alias("tabular"))


def chunk_fixed(spark, d):
    return C.fixed(_docs(spark, d)).select("doc_id", "k", "start", "end", F.md5("content").alias("content_md5"))


def chunk_sentence(spark, d):
    return C.by_sentences(_docs(spark, d), C.ChunkConfig(400, 50, 25)).select("doc_id", "k", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def chunk_paragraph(spark, d):
    return C.by_paragraphs(_docs(spark, d), C.ChunkConfig(1000, 100, 50), "\n").select("doc_id", "k", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def chunk_structure(spark, d):
    return C.by_sections(load(spark, d, STRUCTURED), C.ChunkConfig(300, 50, 50))


def chunk_hybrid(spark, d):
    return C.hybrid(load(spark, d, STRUCTURED), C.ChunkConfig(300, 50, 50))


def _chunks(spark, d):
    return C.fixed(_docs(spark, d)).withColumn("chunk_id", C.chunk_id(F.col("doc_id"), F.col("start"), F.col("content")))


def chunk_links(spark, d):
    return C.links(_chunks(spark, d)).select("doc_id", "start", "previous", "next")


def chunk_overlap(spark, d):
    return C.links(_chunks(spark, d)).select("doc_id", "start", "overlap_previous", "overlap_next")


def chunk_quality(spark, d):
    return C.quality(_chunks(spark, d))


def chunk_section_range_join(spark, d):
    docs = load(spark, d, STRUCTURED)
    return C.containing_section(C.fixed(docs, C.ChunkConfig(300, 50, 50)), S.sections(docs))


def text_overlap(spark, d):
    w = Window.partitionBy("doc_id").orderBy("k")
    rows = C.fixed(_docs(spark, d)).withColumn("before", F.lag("content").over(w)).filter("before IS NOT NULL")
    return rows.select("doc_id", "k", C.text_overlap(F.col("before"), F.col("content"), 60).alias("overlap"))


def tune_chunking(spark, d):
    return C.tune(_docs(spark, d))


def batch_list(spark, d):
    """Batches of 32 words; the hash is over the batches, a line each."""
    rows = dealt(spark, d, "documents", "doc_id").select("doc_id", C.batches(X.words(F.coalesce("text", F.lit(""))), 32).alias("b"))
    return rows.select("doc_id", F.size("b").alias("n_batches"), F.size(F.flatten("b")).alias("n_words"), F.md5(F.array_join(F.transform("b", lambda b: F.array_join(b, " ")), "\n")).alias("batches_md5"))


def page_sections(spark, d):
    return S.page_sections(load(spark, d, PAGED)).withColumn("content_md5", F.md5("content")).drop("content")


def structure_summary(spark, d):
    return S.structure_summary(load(spark, d, STRUCTURED))


def mail_language(spark, d):
    return _docs(spark, d).select("doc_id", X.mail_language(F.col("text")).alias("language"))


def logged_lines(spark, d):
    """The log form of each document's lines: ten at most, of 200 characters."""
    lines = X.logged_list(F.split("text", "\n"))
    return _docs(spark, d).select("doc_id", F.size(lines).alias("n_items"), F.md5(F.array_join(lines, "\n")).alias("items_md5"))


def chunk_semantic(spark, d):
    """Chunks at boundaries that an answer in words proposes; a third of the texts has no answer."""
    answer = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Split at 25, then "), (F.col("doc_id") % 400 + 130).cast("string"), F.lit(" and "), (F.col("doc_id") % 90 + 40).cast("string"), F.lit("; never at 0 or 99999.")))
    rows = C.semantic(load(spark, d, STRUCTURED).withColumn("response", answer), least=30)
    return rows.select("doc_id", "start", "end", F.md5("content").alias("content_md5"))


def fallback_boundaries(spark, d):
    b = C.fallback_boundaries(F.col("text"))
    return load(spark, d, STRUCTURED).select("doc_id", F.array_join(b, ",").alias("boundaries"), F.size(C.at_boundaries(F.col("text"), b, 60)).alias("n_pieces"))


QUERIES = {f.__name__: f for f in (headings, paragraphs, list_runs, table_runs, document_tables, sections, pdf_headings, table_heuristic, chunk_fixed, chunk_sentence, chunk_paragraph, chunk_structure, chunk_hybrid, chunk_links, chunk_overlap, chunk_quality, chunk_section_range_join, text_overlap, tune_chunking, batch_list, chunk_semantic, fallback_boundaries, page_sections, structure_summary, mail_language, logged_lines)}

def _present(text, words):
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


_LINES = f"""SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_number FROM ({STRUCTURED}))"""
_HEADS = f"""SELECT doc_id, text, line_number, CASE WHEN m <> '' THEN length(m) ELSE length(n) - length(replace(n, '.', '')) + 1 END AS level,
    {_strip(f"CASE WHEN m <> '' THEN regexp_extract(line, '{K.MARKDOWN_HEADING}', 2) ELSE regexp_extract(line, '{K.NUMBERED_HEADING}', 2) END")} AS title, position
    FROM (SELECT *, regexp_extract(line, '{K.MARKDOWN_HEADING}', 1) AS m, regexp_extract(line, '{K.NUMBERED_HEADING}', 1) AS n FROM (SELECT *, {_strip('raw')} AS line FROM ({_LINES})))
    WHERE m <> '' OR (n <> '' AND length(line) < 100)"""
_SECTIONS = f"""SELECT h.doc_id, h.level, h.title, h.position AS start, coalesce(min(l.position), any_value(length(h.text))) AS "end", h.text
    FROM ({_HEADS}) h LEFT JOIN ({_HEADS}) l ON l.doc_id = h.doc_id AND l.position > h.position AND l.level <= h.level GROUP BY h.doc_id, h.level, h.title, h.position, h.line_number, h.text"""
_PARAGRAPHS = """SELECT doc_id, i, content, start, start + length(content) AS "end" FROM (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, i - 1 AS i, {strip} AS content FROM (SELECT doc_id, unnest({split}) AS p, generate_subscripts({split}, 1) AS i FROM ({docs})))) WHERE length(content) > 20"""
_DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def _fixed(docs, size, overlap):
    step = size - overlap
    return f"""SELECT doc_id, k, k * {step} AS start, least(k * {step} + {size}, n) AS "end", substr(text, k * {step} + 1, {size}) AS content FROM (
        SELECT doc_id, text, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= {size} THEN 1 ELSE CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS k FROM ({docs}) WHERE {_strip('text')} <> '')"""


def _cut(size, overlap, above):
    step = size - overlap
    return f"""SELECT doc_id, title, start + k * {step} AS start, start + CASE WHEN n <= {above} THEN n ELSE least(k * {step} + {size}, n) END AS "end" FROM (
        SELECT *, unnest(range(0, CASE WHEN n <= {above} THEN 1 ELSE CAST(ceil((n - {size}) / {step}.0) AS BIGINT) + 1 END)) AS k FROM (SELECT *, "end" - start AS n FROM ({_SECTIONS})))"""


_CHUNKS = f"SELECT *, doc_id || '_' || start || '_' || substr(md5(content), 1, 8) AS chunk_id FROM ({_fixed(_DOCS, 1000, 50)})"
_SENTENCES = rf"list_filter(list_transform(string_split_regex(text, '[.!?]+(?:[ \t\n\r\f]+|$)'), lambda p: {_strip('p')}), lambda p: length(p) > 10)"
_LONG_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {_strip('p')}), lambda p: length(p) > 20)"


def _packed(parts, limit, joiner):
    """Greedy packing, a part a step; a full chunk passes its last part on."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {parts} AS ps FROM ({_DOCS})),
        r AS (SELECT doc_id, ps, 1 AS i, 0 AS k, [ps[1]] AS cur, length(ps[1]) AS size FROM d WHERE len(ps) > 0
        UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN big THEN k + 1 ELSE k END, CASE WHEN big THEN [cur[-1], ps[i + 1]] ELSE list_append(cur, ps[i + 1]) END, CASE WHEN big THEN length(cur[-1]) + length(ps[i + 1]) ELSE size + length(ps[i + 1]) END
        FROM (SELECT *, size + length(ps[i + 1]) > {limit} AS big FROM r WHERE i < len(ps)))
        SELECT doc_id, k, length(c) AS n_chars, md5(c) AS content_md5 FROM (SELECT doc_id, k, array_to_string(max_by(cur, i), {joiner}) AS c FROM r GROUP BY doc_id, k)"""


_RUN = "line_number - row_number() OVER (PARTITION BY doc_id ORDER BY line_number)"
_BARS = "length(raw) - length(replace(raw, '|', ''))"
_TABLES = f"SELECT doc_id, min(line_number) AS start_line, max(line_number) AS end_line, count(*) AS n_rows FROM (SELECT doc_id, line_number, {_RUN} AS run FROM (LINES) WHERE {_BARS} >= 2) GROUP BY doc_id, run HAVING count(*) >= 2"
_ALL_LINES = f"SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_number FROM ({_DOCS})"
_SIGNS = f"CAST(contains(s, '|') AS INT) + CAST(contains(s, chr(9)) AS INT) + CAST(contains(s, '   ') AS INT) + CAST({_n('s', '[0-9]+')} >= 3 AS INT)"
SQL = {
    "headings": f"SELECT doc_id, line_number, level, title, position FROM ({_HEADS})",
    "paragraphs": "SELECT doc_id, i, start, \"end\", " + _n("content", r"[^ \t\n\r\f]+") + " AS n_words, md5(content) AS content_md5 FROM (" + _PARAGRAPHS.format(strip=_strip("p"), split=r"string_split_regex(text, '\n[ \t\n\r\f]*\n')", docs=STRUCTURED) + ")",
    "list_runs": f"""SELECT doc_id, min(line_number) AS start_line, max(line_number) AS end_line, count(*) AS n_items, min_by(CASE WHEN regexp_matches(raw, '{K.BULLET_ITEM}') THEN 'bullet' ELSE 'numbered' END, line_number) AS list_type
        FROM (SELECT *, {_RUN} AS run FROM ({_LINES}) WHERE regexp_matches(raw, '{K.BULLET_ITEM}') OR regexp_matches(raw, '{K.NUMBER_ITEM}') OR regexp_matches(raw, '{K.LETTER_ITEM}')) GROUP BY doc_id, run""",
    "table_runs": _TABLES.replace("(LINES)", f"({_LINES})"),
    "document_tables": _TABLES.replace("(LINES)", f"({_ALL_LINES})"),
    "sections": 'SELECT doc_id, level, title, start, "end", ' + _n('substr(text, start + 1, "end" - start)', r"[^ \t\n\r\f]+") + f" AS n_words FROM ({_SECTIONS})",
    "pdf_headings": rf"""SELECT doc_id, line_number, heading_type, CASE heading_type WHEN 'numbered' THEN least(length(n) - length(replace(n, '.', '')) + 1, 3) WHEN 'capitals' THEN 1 ELSE 2 END AS level FROM (
        SELECT *, CASE WHEN n <> '' THEN 'numbered' WHEN regexp_matches(line, '^[A-Z][A-Z ]{{3,}}$') THEN 'capitals' WHEN regexp_matches(line, '^[A-Z][a-z]+( [A-Z][a-z]+)*$') THEN 'title' END AS heading_type FROM (
        SELECT *, regexp_extract(line, '^(\d+(?:\.\d+)*)\.?\s+[A-Z]', 1) AS n FROM (SELECT *, {_strip('raw')} AS line FROM ({_LINES})) WHERE length(line) BETWEEN 1 AND 100)) WHERE heading_type IS NOT NULL""",
    "table_heuristic": f"SELECT doc_id, coalesce(list_sum(list_transform(f, lambda s: {_SIGNS})), 0) > 0.2 * len(f) AS tabular FROM (SELECT doc_id, list_filter(string_split({_T}, chr(10)), lambda s: {_strip('s')} <> '') AS f FROM documents)",
    "chunk_fixed": f'SELECT doc_id, k, start, "end", md5(content) AS content_md5 FROM ({_fixed(_DOCS, 1000, 50)})',
    "chunk_sentence": _packed(_SENTENCES, 400, "' '"),
    "chunk_paragraph": _packed(_LONG_LINES, 1000, "chr(10) || chr(10)"),
    "chunk_structure": _cut(300, 50, 300),
    "chunk_hybrid": f"""SELECT doc_id, title, start, "end" FROM ({_SECTIONS}) WHERE "end" - start <= 450 UNION ALL
        SELECT doc_id, title, start + w.s, start + w.e FROM (SELECT doc_id, title, start, unnest(CASE WHEN len(good) > 0 THEN good ELSE [struct_pack(s := 0, e := n)] END) AS w FROM (
        SELECT *, list_filter(list_transform(range(1, len(es)), lambda i: struct_pack(s := es[i], e := es[i + 1])), lambda x: x.e - x.s >= 50) AS good FROM (SELECT *, list_concat([0], bs, [n]) AS es FROM (
        SELECT *, list_filter(list_transform(range(1, len(ps) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda p: length(p) + 2)) AS BIGINT)), lambda b: b < n) AS bs FROM (
        SELECT doc_id, title, start, "end" - start AS n, string_split(substr(text, start + 1, "end" - start), chr(10) || chr(10)) AS ps FROM ({_SECTIONS}) WHERE "end" - start > 450)))))""",
    "chunk_links": f"SELECT doc_id, start, 'previous:' || lag(chunk_id) OVER w AS previous, 'next:' || lead(chunk_id) OVER w AS next FROM ({_CHUNKS}) WINDOW w AS (PARTITION BY doc_id ORDER BY start)",
    "chunk_overlap": f"SELECT doc_id, start, greatest(0, least(50, coalesce(lag(\"end\") OVER w - start, 0))) AS overlap_previous, greatest(0, least(50, coalesce(\"end\" - lead(start) OVER w, 0))) AS overlap_next FROM ({_CHUNKS}) WINDOW w AS (PARTITION BY doc_id ORDER BY start)",
    "chunk_quality": f"SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE length(content) < 100) AS n_small, count(*) FILTER (WHERE length(content) > 1200) AS n_large, count(*) - count(DISTINCT md5(content)) AS n_repeated, CAST(floor(avg(length(content))) AS BIGINT) AS avg_size, min(length(content)) AS min_size, max(length(content)) AS max_size FROM ({_CHUNKS}) GROUP BY doc_id",
    "chunk_section_range_join": f"""SELECT c.doc_id, c.start, min_by(s.title, struct_pack(a := s.start, b := s."end")) AS section FROM ({_fixed(STRUCTURED, 300, 50)}) c LEFT JOIN ({_SECTIONS}) s ON s.doc_id = c.doc_id AND c.start BETWEEN s.start AND s."end" GROUP BY c.doc_id, c.start""",
    "text_overlap": f"SELECT doc_id, k, coalesce(list_max(list_filter(range(0, least(length(b), length(content), 60) + 1), lambda i: right(b, i) = left(content, i))), 0) AS overlap FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM ({_fixed(_DOCS, 1000, 50)})) WHERE b IS NOT NULL",
    "tune_chunking": f"""WITH m AS (SELECT doc_id, CAST(floor(avg(length(content))) AS BIGINT) AS mean FROM ({_PARAGRAPHS.format(strip=_strip("p"), split="string_split(text, chr(10))", docs=_DOCS)}) GROUP BY doc_id),
        b AS (SELECT d.doc_id, CASE WHEN mean > 0 THEN greatest(100, least(CAST(floor(length(text) / 10.0) AS BIGINT), mean * 3)) ELSE CAST(floor(length(text) / 10.0) AS BIGINT) END AS best FROM ({_DOCS}) d LEFT JOIN m USING (doc_id))
        SELECT doc_id, best AS max_size, greatest(50, CAST(floor(best / 10.0) AS BIGINT)) AS min_size, greatest(25, CAST(floor(best / 20.0) AS BIGINT)) AS overlap FROM b""",
    "batch_list": "SELECT doc_id, len(b) AS n_batches, len(w) AS n_words, md5(array_to_string(b, chr(10))) AS batches_md5 FROM (SELECT doc_id, w, list_transform(range(0, greatest(1, CAST(ceil(len(w) / 32.0) AS BIGINT))), lambda i: array_to_string(w[i * 32 + 1:i * 32 + 32], ' ')) AS b FROM (SELECT doc_id, regexp_extract_all(" + _T + r", '[^ \t\n\r\f]+') AS w FROM documents))",
    "page_sections": f"""SELECT doc_id, section, max(line) FILTER (WHERE head) AS title, min(page) AS page_start, max(page) AS page_end, count(*) FILTER (WHERE NOT head) AS n_lines, sum({_n('line', r'[^ \t\n\r\f]+')}) FILTER (WHERE NOT head) AS n_words,
        md5(string_agg(line, chr(10) ORDER BY page, line_number) FILTER (WHERE NOT head)) AS content_md5 FROM (
        SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY page, line_number) AS section FROM (SELECT *, regexp_matches(line, '{K.PAGE_SECTION_PATTERNS[0]}') OR regexp_matches(line, '{K.PAGE_SECTION_PATTERNS[1]}') OR regexp_matches(line, '{K.PAGE_SECTION_PATTERNS[2]}') AS head FROM (
        SELECT doc_id, page, line_number, {_strip('raw')} AS line FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM ({PAGED}))) WHERE line <> ''))
        WHERE section > 0 GROUP BY doc_id, section HAVING count(*) FILTER (WHERE NOT head) > 0""",
    "structure_summary": f"""WITH d AS (SELECT doc_id FROM ({STRUCTURED})), h AS (SELECT doc_id, count(*) AS n, max(level) AS deepest FROM ({_HEADS}) GROUP BY doc_id), s AS (SELECT doc_id, count(*) AS n FROM ({_SECTIONS}) GROUP BY doc_id),
        p AS (SELECT doc_id, count(*) AS n FROM ({_PARAGRAPHS.format(strip=_strip("p"), split=r"string_split_regex(text, '\n[ \t\n\r\f]*\n')", docs=STRUCTURED)}) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS n, sum(items) AS items FROM (SELECT doc_id, run, count(*) AS items FROM (SELECT doc_id, {_RUN} AS run FROM ({_LINES}) WHERE regexp_matches(raw, '{K.BULLET_ITEM}') OR regexp_matches(raw, '{K.NUMBER_ITEM}') OR regexp_matches(raw, '{K.LETTER_ITEM}')) GROUP BY doc_id, run) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n FROM ({_TABLES.replace("(LINES)", f"({_LINES})")}) GROUP BY doc_id)
        SELECT doc_id, coalesce(h.n, 0) AS n_headings, coalesce(p.n, 0) AS n_paragraphs, coalesce(l.n, 0) AS n_lists, coalesce(l.items, 0) AS n_items, coalesce(t.n, 0) AS n_tables, coalesce(s.n, 0) AS n_sections, h.deepest, coalesce(h.n, 0) >= 2 AS hierarchical, coalesce(s.n, 0) > 1 AS several_sections
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "mail_language": f"""SELECT doc_id, CASE WHEN length(t) = 0 THEN 'unknown' WHEN en >= es AND en >= fr THEN 'english' WHEN es >= fr THEN 'spanish' ELSE 'french' END AS language FROM (SELECT doc_id, t, {_present('t', K.MAIL_ENGLISH_WORDS)} AS en, {_present('t', K.MAIL_SPANISH_WORDS)} AS es, {_present('t', K.MAIL_FRENCH_WORDS)} AS fr FROM (SELECT doc_id, lower({_T}) AS t FROM documents))""",
    "logged_lines": f"""SELECT doc_id, len(l) AS n_items, md5(array_to_string(l, chr(10))) AS items_md5 FROM (SELECT doc_id, list_transform(string_split({_T}, chr(10))[1:10], lambda s: CASE WHEN regexp_matches(lower(s), 'password|token|key|secret') THEN '[REDACTED]' WHEN length(s) > 200 THEN left(s, 197) || '...' ELSE s END) AS l FROM documents)""",
    "chunk_semantic": rf"""WITH d AS (SELECT doc_id, text, length(text) AS n, string_split(text, chr(10) || chr(10)) AS ps, CASE WHEN doc_id % 3 <> 0 THEN 'Split at 25, then ' || (doc_id % 400 + 130) || ' and ' || (doc_id % 90 + 40) || '; never at 0 or 99999.' END AS answer FROM ({STRUCTURED})),
        b AS (SELECT *, CASE WHEN answer IS NULL THEN list_transform(range(1, len(ps) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda p: length(p) + 2)) AS BIGINT)) ELSE list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\d+'), lambda x: CAST(x AS BIGINT)))) END AS all_bs FROM d),
        e AS (SELECT doc_id, text, list_concat([0], list_filter(all_bs, lambda x: x > 0 AND x < n), [n]) AS es FROM b), p AS (SELECT doc_id, text, es, unnest(range(1, len(es))) AS i FROM e),
        c AS (SELECT doc_id, es[i] AS start, es[i + 1] AS "end", {_strip('substr(text, es[i] + 1, es[i + 1] - es[i])')} AS content FROM p)
        SELECT doc_id, start, "end", md5(content) AS content_md5 FROM c WHERE length(content) >= 30""",
    "fallback_boundaries": f"""SELECT doc_id, array_to_string(bs, ',') AS boundaries, greatest(1, len(list_filter(range(1, len(es)), lambda i: es[i + 1] - es[i] >= 60))) AS n_pieces FROM (
        SELECT doc_id, bs, list_concat([0], bs, [n]) AS es FROM (SELECT doc_id, length(text) AS n, list_filter(list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p) + 2))), lambda b: b < length(text)) AS bs
        FROM (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS ps FROM ({STRUCTURED}))))""",
}
