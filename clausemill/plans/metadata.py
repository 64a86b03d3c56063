"""Queries on semi-structured metadata, built from ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..sources.tables import dealt, table
from .profile import SQL as PROFILE_SQL

_LEFT = """to_json(named_struct('source', named_struct('name', coalesce(source, 'none'), 'lang', coalesce(lang, 'none')), 'stats', named_struct('n', n_chars, 'words', named_struct('all', doc_id % 97)), 'tags', array('a', lang), 'flat', doc_id))"""
_RIGHT = """to_json(named_struct('source', named_struct('name', concat('new ', coalesce(source, 'none'))), 'stats', named_struct('words', named_struct('long', doc_id % 11), 'n', doc_id), 'flat', named_struct('now', named_struct('deep', named_struct('er', doc_id % 3 = 0)))))"""


def _listed(v):
    return F.array_join(F.array_sort(F.transform(M.leaves(v), lambda x: F.concat(x["path"], F.lit("="), x["value"]))), "\n")


def metadata_deep_merge(spark, d):
    """Two metadata objects of each document merged at every level, and their numbers of fields."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(f"parse_json({_LEFT})").alias("a"), F.expr(f"parse_json({_RIGHT})").alias("b"))
    merged = rows.withColumn("m", M.deep_merge(F.col("a"), F.col("b")))
    return merged.select("doc_id", *[M.leaf_count(F.col(c)).alias(n) for c, n in (("a", "n_original"), ("b", "n_added"), ("m", "n_merged"))], _listed(F.col("m")).alias("fields"))


def metadata_leaves(spark, d):
    """Each event's properties laid under two more levels, a row for each field."""
    v = F.expr("parse_json(concat('{\"event\":{\"type\":\"', event_type, '\",\"props\":', props, '},\"user\":', user_id, '}'))")
    return table(spark, d, "events").select("event_id", F.explode(M.leaves(v)).alias("f")).select("event_id", "f.path", "f.value")


def metadata_tree(spark, d):
    """Fields of the whole metadata document, picked out of its groups, and how many it has."""
    rows = dealt(spark, d, "documents", "doc_id").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    counts = M.text_counts(F.col("text"))
    rows = rows.withColumns({f"_{k}": c for k, c in counts.items()})
    known = {k: F.col(f"_{k}") for k in counts}
    rows = rows.withColumn("_ease", T.readability(F.col("text"), known["words"], known["sentences"]))
    doc = M.document(F.col("text"), F.col("source"), F.col("lang"), F.lit(1), F.col("source").isNotNull(), known, F.col("_ease"))
    rows = rows.select("doc_id", doc.alias("m"))
    get = lambda path, kind: F.try_variant_get("m", path, kind)
    return rows.select("doc_id", F.size(F.map_keys(M.fields(F.col("m")))).alias("n_groups"), get("$.source.name", "string").alias("source"), get("$.document.n_words", "long").alias("n_words"), get("$.content_analysis.language.language", "string").alias("language"),
                       F.round(get("$.content_analysis.readability.flesch", "double"), 6).alias("flesch"), get("$.accessibility.reading_level", "string").alias("reading_level"), get("$.structure.has_lists", "boolean").alias("has_lists"), get("$.structure.is_hierarchical", "boolean").alias("is_hierarchical"), get("$.technical.sha256", "string").alias("sha256"))


def _scans(spark, d):
    """Scan metadata of three formats, with keys that some rows lack."""
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("email"), F.lit("text")), (F.col("doc_id") % 4 + 1).cast("int"))
    meta = F.expr("""parse_json(to_json(named_struct('page_count', IF(doc_id % 3 = 0, NULL, n_chars DIV 100), 'images_detected', doc_id % 5, 'tables_count', IF(doc_id % 2 = 0, doc_id % 7, NULL), 'tables_detected', 3,
        'pdf_metadata', IF(doc_id % 8 = 0, NULL, named_struct('Producer', source, 'Title', concat('T', doc_id))), 'document_properties', named_struct('title', concat('D', doc_id), 'author', source), 'styles_used', array('Normal', lang),
        'headers', named_struct('subject', concat('S', doc_id), 'from', concat(source, '@x.org')), 'structure', named_struct('is_multipart', doc_id % 6 = 2), 'attachments', sequence(1, 1 + doc_id % 4))))""")
    return table(spark, d, "documents").select("doc_id", "text", kind.alias("kind"), meta.alias("meta"))


def format_metadata(spark, d):
    rows = _scans(spark, d).select("doc_id", "kind", M.format_specific(F.col("kind"), F.col("meta")).alias("f"))
    get = lambda path, t: F.try_variant_get("f", path, t)
    return rows.select("doc_id", "kind", get("$.pdf_version", "string").alias("pdf_version"), get("$.page_count", "long").alias("page_count"), get("$.has_images", "boolean").alias("has_images"), get("$.title", "string").alias("title"), get("$.author", "string").alias("author"),
                       get("$.tables_count", "long").alias("tables_count"), get("$.subject", "string").alias("subject"), get("$.from_address", "string").alias("from_address"), get("$.is_multipart", "boolean").alias("is_multipart"), get("$.attachment_count", "long").alias("attachment_count"))


def embedded_objects(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" http://a.org/x and https://b.org"))
    return _scans(spark, d).select("doc_id", *[c.alias(k) for k, c in M.embedded(text, F.col("meta")).items()])


def structure_flags(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.structure_counts(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.select("doc_id", *[c.alias(k) for k, c in M.structure_flags(F.col("n")).items()])


def content_probes(spark, d):
    """Bytes that begin as PDF, zip or text, by turns."""
    start = F.element_at(F.array(*[F.lit(x) for x in ("%PDF-1.7 ", "PK\x03\x04", "", "%PDF-x")]), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(start, F.coalesce("text", F.lit(""))).cast("binary")
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in M.probes(content).items()])


QUERIES = {f.__name__: f for f in (metadata_deep_merge, metadata_leaves, metadata_tree, format_metadata, embedded_objects, structure_flags, content_probes)}

_A = "json_object('source', json_object('name', coalesce(source, 'none'), 'lang', coalesce(lang, 'none')), 'stats', json_object('n', n_chars, 'words', json_object('all', doc_id % 97)), 'tags', json_array('a', lang), 'flat', doc_id)"
_B = "json_object('source', json_object('name', concat('new ', coalesce(source, 'none'))), 'stats', json_object('words', json_object('long', doc_id % 11), 'n', doc_id), 'flat', json_object('now', json_object('deep', json_object('er', doc_id % 3 = 0))))"
_LEAF = "t.type <> 'OBJECT' AND NOT contains(t.fullkey, '[')"


def _n_leaves(j):
    return f"(SELECT count(*) FROM json_tree({j}) t WHERE {_LEAF})"


SQL = {
    "metadata_deep_merge": f"""WITH r AS (SELECT doc_id, {_A} AS a, {_B} AS b, json_merge_patch({_A}, {_B}) AS m FROM documents)
        SELECT doc_id, {_n_leaves('a')} AS n_original, {_n_leaves('b')} AS n_added, {_n_leaves('m')} AS n_merged, (SELECT string_agg(t.fullkey || '=' || coalesce(t.value::VARCHAR, 'null'), chr(10) ORDER BY t.fullkey) FROM json_tree(m) t WHERE {_LEAF}) AS fields FROM r""",
    "metadata_leaves": "SELECT event_id, p AS path, v AS value FROM (SELECT event_id, unnest(['$.event.props.k', '$.event.type', '$.user']) AS p, unnest([json_extract(props, '$.k')::VARCHAR, '\"' || event_type || '\"', user_id::VARCHAR]) AS v FROM events)",
    "metadata_tree": f"""SELECT doc_id, 8 AS n_groups, d.source, n_words, language, flesch, reading_level, list_lines > 0 AS has_lists, heading_lines >= 2 AS is_hierarchical, sha256(coalesce(text, '')) AS sha256
        FROM documents d JOIN ({PROFILE_SQL['text_stats']}) USING (doc_id) JOIN ({PROFILE_SQL['language']}) USING (doc_id) JOIN ({PROFILE_SQL['readability']}) USING (doc_id) JOIN ({PROFILE_SQL['structure_counts']}) USING (doc_id)""",
    "format_metadata": """SELECT doc_id, kind, CASE WHEN kind = 'pdf' THEN CASE WHEN doc_id % 8 = 0 THEN 'Unknown' ELSE coalesce(source, 'Unknown') END END AS pdf_version, CASE WHEN kind = 'pdf' THEN CASE WHEN doc_id % 3 = 0 THEN 0 ELSE coalesce(n_chars // 100, 0) END END AS page_count,
        CASE WHEN kind = 'pdf' THEN doc_id % 5 > 0 END AS has_images, CASE WHEN kind = 'pdf' AND doc_id % 8 <> 0 THEN 'T' || doc_id WHEN kind = 'docx' THEN 'D' || doc_id END AS title, CASE WHEN kind = 'docx' THEN source END AS author,
        CASE WHEN kind = 'docx' THEN CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 ELSE 0 END END AS tables_count, CASE WHEN kind = 'email' THEN 'S' || doc_id END AS subject, CASE WHEN kind = 'email' THEN source || '@x.org' END AS from_address,
        CASE WHEN kind = 'email' THEN doc_id % 6 = 2 END AS is_multipart, CASE WHEN kind = 'email' THEN 1 + doc_id % 4 END AS attachment_count FROM (SELECT *, ['pdf', 'docx', 'email', 'text'][doc_id % 4 + 1] AS kind FROM documents)""",
    "embedded_objects": rf"""SELECT doc_id, doc_id % 5 AS images, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 ELSE 3 END AS tables, len(regexp_extract_all(coalesce(text, '') || ' http://a.org/x and https://b.org', '{T.K.URL}')) AS hyperlinks, (1 + doc_id % 4)::INTEGER AS attachments FROM documents""",
    "structure_flags": f"SELECT doc_id, heading_lines > 0 AS has_headings, heading_lines >= 2 AS is_hierarchical, list_lines > 0 AS has_lists, table_lines > 0 AS has_tables FROM ({PROFILE_SQL['structure_counts']})",
    "content_probes": """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'zip' ELSE 'none' END AS compression, CASE WHEN doc_id % 4 = 0 THEN '1.7' END AS format_version,
        CASE WHEN doc_id % 4 <> 2 THEN 'binary' WHEN strlen(coalesce(text, '')) = length(coalesce(text, '')) THEN 'ascii' ELSE 'utf-8' END AS encoding FROM documents""",
}
