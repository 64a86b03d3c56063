"""Text profile queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..sources.tables import table


def T():
    return F.coalesce(F.col("text"), F.lit(""))


def _docs(spark, d, cols, names=("doc_id",)):
    """``names`` and the given columns, doubles rounded at the end."""
    rows = table(spark, d, "documents").select(*names, *[c.alias(k) for k, c in cols.items()])
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _fields(spark, d, struct):
    """doc_id and the fields of a struct, which is made once a text; doubles rounded."""
    rows = table(spark, d, "documents").select("doc_id", struct.alias("x")).select("doc_id", "x.*")
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def text_stats(spark, d):
    return _docs(spark, d, X.statistics(T()))


def char_counts(spark, d):
    return _docs(spark, d, X.character_counts(T()))


def language(spark, d):
    return _fields(spark, d, X.language(T()))


def readability(spark, d):
    return _fields(spark, d, X.readability(T()))


def simple_readability(spark, d):
    return _docs(spark, d, {"readability": X.simple_readability(T())})


def pattern_counts(spark, d):
    return _docs(spark, d, X.pattern_counts(T()))


def pii_flags(spark, d):
    return _docs(spark, d, {"has_pii": X.matches_any(T(), [K.SSN, K.CARD, K.EMAIL]), "has_financial": X.matches_any(T(), K.FINANCIAL_PATTERNS), "has_health": X.present(F.lower(T()), K.HEALTH_WORDS) > 0})


def sentiment(spark, d):
    return _docs(spark, d, X.sentiment(T()))


def structure_counts(spark, d):
    return _fields(spark, d, X.structure_counts(T()))


def quality_score(spark, d):
    """Lines stand for sections."""
    return _docs(spark, d, {"quality": X.quality_score(T(), F.size(X.nonblank_parts(T(), "\n")), F.col("source").isNotNull())})


def char_diversity(spark, d):
    return _docs(spark, d, {"n_distinct": X.distinct_characters(T())})


def hashes(spark, d):
    b = T().cast("binary")
    return _docs(spark, d, {"md5": F.md5(b), "sha1": F.sha1(b), "sha256": F.sha2(b, 256), "cache_key": F.concat(F.lit("model:"), F.substring(F.sha2(b, 256), 1, 16))})


def valid_docs(spark, d):
    n = F.length(X.strip(T()))
    return _docs(spark, d, {"valid": (n >= 10) & F.col("source").isNotNull(), "error_code": F.when(n < 10, "too_short").when(F.col("source").isNull(), "no_source")})


def truncate(spark, d):
    return _docs(spark, d, {"short": X.truncate(T(), 100), "context_length": F.length(F.left(T(), F.lit(4000)))})


def redact(spark, d):
    return _docs(spark, d, {"logged": X.truncate(X.redact(T()), 200)})


def sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(T())).alias("i", "s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"), F.max(F.length("s")).alias("longest"))


def doc_title(spark, d):
    """First of ten lines that is under 200 characters and in capitals or names an agreement."""
    good = lambda s: (F.length(s) < 200) & (F.length(s) > 0) & ((F.upper(s) == s) & (F.lower(s) != s) | F.lower(s).rlike("agreement|contract|policy|license"))
    first = F.filter(F.transform(F.slice(F.split(T(), "\n"), 1, 10), X.strip), good)
    return _docs(spark, d, {"title": F.try_element_at(first, F.lit(1))})


def normalize(spark, d):
    """The texts are made unruly first: other spaces, quotes, dashes and line ends."""
    unruly = F.replace(F.replace(F.replace(F.replace(T(), F.lit(". "), F.lit(".\u00a0 ")), F.lit(", "), F.lit(" \u2013 ")), F.lit("\n"), F.lit("\r\n")), F.lit(" the "), F.lit(" \u201cthe\u201d "))
    out = X.nfc(X.normalise(unruly))
    return _docs(spark, d, {"sha": F.sha2(out.cast("binary"), 256), "before": F.length(unruly), "after": F.length(out)})


def contractions(spark, d):
    out = X.expand_contractions(F.replace(F.replace(T(), F.lit(" is "), F.lit(" isn't ")), F.lit(" and "), F.lit(" we'll ")))
    return _docs(spark, d, {"n_chars": F.length(out), "sha": F.sha2(out.cast("binary"), 256)})


def title_case(spark, d):
    """Capital lines in title case, over texts whose ASCII lines with an even number of characters
    were made capitals first: the text's hash and how many capitals became small."""
    loud = F.array_join(F.transform(F.split(T(), "\n"), lambda s: F.when((F.length(s) % 2 == 0) & ~s.rlike(r"[^\x00-\x7f]"), F.upper(s)).otherwise(s)), "\n")
    out = X.title_case_lines(loud)
    capitals = lambda c: F.regexp_count(c, F.lit("[A-Z]"))
    return _docs(spark, d, {"sha": F.sha2(out.cast("binary"), 256), "n_lowered": capitals(loud) - capitals(out)})


def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


def html_to_text(spark, d):
    t = X.html_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n_chars"), F.sha2(t.cast("binary"), 256).alias("sha"))


def html_security(spark, d):
    return table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in X.html_security(F.col("html")).items()])


URL_OK = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/\S*)?$"


def valid_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").rlike(URL_OK).alias("valid"))


def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("domain"))


def source_meta(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    name = F.regexp_extract(path, "[^/]*$", 0)
    b = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return table(spark, d, "pages").select("page_id", path.alias("path"), name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.length(b).cast("long").alias("n_bytes"), F.md5(F.concat_ws(":", F.col("url"), F.sha2(b, 256))).alias("document_id"))


QUERIES = {f.__name__: f for f in (text_stats, char_counts, language, readability, simple_readability, pattern_counts, pii_flags, sentiment, structure_counts, quality_score, char_diversity, hashes, valid_docs, truncate, redact, sentences, doc_title, normalize, contractions, title_case, safe_filename, html_to_text, html_security, valid_urls, url_domain, source_meta)}

_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_T = "coalesce(text, '')"


def _strip(x):
    return f"trim({x}, {_STRIP})"


def _n(x, p):
    return f"len(regexp_extract_all({x}, '{p.replace(chr(39), chr(39) * 2)}'))"


def _any(x, ps):
    return "(" + " OR ".join(f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + ")"


def _words(x):
    return f"list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


def _parts(x, sep):
    return f"list_filter(list_transform(string_split({x}, {sep}), lambda p: {_strip('p')}), lambda p: p <> '')"


def _present(x, ws):
    return "(" + " + ".join(f"CAST(contains({x}, '{w}') AS INT)" for w in ws) + ")"


_W = _n(_T, r"[^ \t\n\r\f]+")
_S = f"len({_parts(_T, chr(39) + '.' + chr(39))})"
_PADDED = f"' ' || lower({_T}) || ' '"
_EN, _ES, _FR = (_present(_PADDED, [f" {w} " for w in ws]) for ws in (K.ENGLISH_WORDS, K.SPANISH_WORDS, K.FRENCH_WORDS))
_G = r"len(regexp_extract_all(lower(w), '[aeiouy]+'))"
_SYL = f"coalesce(list_sum(list_transform({_words(_T)}, lambda w: greatest({_G} - CASE WHEN suffix(lower(w), 'e') AND {_G} > 1 THEN 1 ELSE 0 END, 1))), 0)"
_FLESCH = f"CASE WHEN {_W} > 0 AND {_S} > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({_W}::DOUBLE / {_S}) - 84.6::DOUBLE * ({_SYL}::DOUBLE / {_W}) ELSE 0 END"
_COHERENCE = f"CASE WHEN {_S} = 0 THEN 0.0 WHEN list_sum(list_transform({_parts(_T, chr(39) + '.' + chr(39))}, lambda p: {_n('p', r'[^ \t\n\r\f]+')}))::DOUBLE / {_S} BETWEEN 5 AND 30 THEN 0.8 ELSE 0.5 END"
_SECTIONS = f"(len({_parts(_T, 'chr(10)')}) > 1)"
_BARS = "(length(s) - length(replace(s, '|', '')))"
_TEXT_UNRULY = f"replace(replace(replace(replace({_T}, '. ', '.' || chr(160) || ' '), ', ', ' ' || chr(8211) || ' '), chr(10), chr(13) || chr(10)), ' the ', ' ' || chr(8220) || 'the' || chr(8221) || ' ')"


def _translate(x, chars, to):
    return f"translate({x}, {' || '.join(f'chr({ord(c)})' for c in chars)}, '{to}')"


_NORMAL = _translate(f"regexp_replace(U, '\\r\\n?', chr(10), 'g')", K.UNICODE_SPACES, " " * len(K.UNICODE_SPACES))
_NORMAL = f"regexp_replace({_NORMAL}, ' {{2,}}', ' ', 'g')"
_NORMAL = _translate(_NORMAL, K.DOUBLE_QUOTES, '"' * len(K.DOUBLE_QUOTES))
_NORMAL = _translate(_NORMAL, K.SINGLE_QUOTES, "''" * len(K.SINGLE_QUOTES))
_NORMAL = f"nfc_normalize({_translate(_NORMAL, K.DASHES, '-' * len(K.DASHES))})"
_CONTRACT = f"replace(replace({_T}, ' is ', ' isn''t '), ' and ', ' we''ll ')"
for _a, _b in K.CONTRACTIONS:
    _CONTRACT = "replace({}, '{}', '{}')".format(_CONTRACT, _a.replace("'", "''"), _b)
_HTML = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _a, _b in X.ENTITIES:
    _HTML = "replace({}, '{}', '{}')".format(_HTML, _a, _b.replace("'", "''"))
_HTML = f"trim(regexp_replace({_HTML}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_TITLE = f"list_filter(list_transform(string_split({_T}, chr(10))[1:10], lambda s: {_strip('s')}), lambda s: length(s) < 200 AND length(s) > 0 AND ((upper(s) = s AND lower(s) <> s) OR regexp_matches(lower(s), 'agreement|contract|policy|license')))"
_LOUD = f"array_to_string(list_transform(string_split({_T}, chr(10)), lambda s: CASE WHEN length(s) % 2 = 0 AND NOT regexp_matches(s, '[^\\x00-\\x7f]') THEN upper(s) ELSE s END), chr(10))"
_TITLED = f"""array_to_string(list_transform(string_split(loud, chr(10)), lambda s: CASE WHEN upper(s) = s AND lower(s) <> s AND len({_words('s')}) <= 10 AND NOT regexp_matches(s, '[0-9]')
    THEN array_to_string(list_transform(string_split(lower(s), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE s END), chr(10))"""
_BLANK_RUN = r"[ \t\n\r\f]+"

SQL = {
    "text_stats": f"""SELECT doc_id, length({_T}) AS n_chars, {_W} AS n_words, {_S} AS n_sentences, len({_parts(_T, 'chr(10) || chr(10)')}) AS n_paragraphs, len({_parts(_T, 'chr(10)')}) AS n_lines,
        round({_W}::DOUBLE / greatest(len(string_split({_T}, '.')), 1), 6) AS words_per_sentence, round({_W}::DOUBLE / greatest(len({_parts(_T, 'chr(10) || chr(10)')}), 1), 6) AS words_per_paragraph FROM documents""",
    "char_counts": "SELECT doc_id, length(t) AS total, " + ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) AS {n}" for n, p in (("alphabetic", r"[^\p{L}]+"), ("numeric", r"[^\p{Nd}]+"), ("white_space", r"[^ \t\n\r\f]+"), ("punctuation", "[^.,;:!?]+"), ("special", r"[\p{L}\p{N} \t\n\r\f]+"))) + f" FROM (SELECT doc_id, {_T} AS t FROM documents)",
    "language": f"""SELECT doc_id, CASE WHEN length(t) = 0 THEN 'unknown' WHEN en >= es AND en >= fr THEN 'english' WHEN es >= fr THEN 'spanish' ELSE 'french' END AS language,
        CASE WHEN length(t) = 0 THEN 0 WHEN en >= es AND en >= fr THEN en WHEN es >= fr THEN es ELSE fr END AS indicators,
        round(CASE WHEN length(t) = 0 THEN 0 ELSE least((CASE WHEN en >= es AND en >= fr THEN en WHEN es >= fr THEN es ELSE fr END)::DOUBLE / greatest(w * 0.1::DOUBLE, 1.0), 1.0) END, 6) AS confidence
        FROM (SELECT doc_id, {_T} AS t, {_EN} AS en, {_ES} AS es, {_FR} AS fr, {_W} AS w FROM documents)""",
    "readability": f"""SELECT doc_id, round(f, 6) AS flesch, CASE WHEN NOT ok THEN 'unknown' {' '.join(f"WHEN f >= {a} THEN '{b}'" for a, b in K.READING_LEVELS)} ELSE 'very_difficult' END AS reading_level
        FROM (SELECT doc_id, {_FLESCH} AS f, {_W} > 0 AND {_S} > 0 AS ok FROM documents)""",
    "simple_readability": f"SELECT doc_id, round(CASE WHEN {_W} > 0 AND {_S} > 0 THEN greatest(0.0, 1 - least({_W}::DOUBLE / {_S} / 20 + length(regexp_replace({_T}, '{_BLANK_RUN}', '', 'g'))::DOUBLE / {_W} / 10, 1.0)) ELSE 0 END, 6) AS readability FROM documents",
    "pattern_counts": "SELECT doc_id, " + ", ".join(f"{_n(_T, p)} AS {k}" for k, p in K.CONTENT_PATTERNS.items()) + " FROM documents",
    "pii_flags": f"SELECT doc_id, {_any(_T, [K.SSN, K.CARD, K.EMAIL])} AS has_pii, {_any(_T, K.FINANCIAL_PATTERNS)} AS has_financial, {_present(f'lower({_T})', K.HEALTH_WORDS)} > 0 AS has_health FROM documents",
    "sentiment": f"SELECT doc_id, {_present(f'lower({_T})', K.POSITIVE_WORDS)} AS positive, {_present(f'lower({_T})', K.NEGATIVE_WORDS)} AS negative, {_present(f'lower({_T})', K.URGENT_WORDS)} AS urgent FROM documents",
    "structure_counts": f"""SELECT doc_id, len(list_filter(ls, lambda s: {_any(_strip('s'), K.HIERARCHY_PATTERNS)})) AS heading_lines, len(list_filter(ls, lambda s: {_any('s', K.LIST_PATTERNS)})) AS list_lines,
        len(list_filter(ls, lambda s: (len({_words('s')}) >= 3 AND contains(s, '   ')) OR len(string_split(s, chr(9))) >= 3 OR {_BARS} >= 2)) AS table_lines FROM (SELECT doc_id, string_split({_T}, chr(10)) AS ls FROM documents)""",
    "quality_score": f"""SELECT doc_id, round(((CAST({_strip(_T)} <> '' AS INT) + CAST(length({_T}) > 100 AS INT) + CAST({_SECTIONS} AS INT) + CAST(length({_strip(_T)}) >= 10 AS INT)) / 4.0::DOUBLE
        + (({_FLESCH}) / 100 + 1 + CAST({_SECTIONS} AS INT)) / 3
        + (1.0 + CASE WHEN length({_T}) = 0 THEN 0 ELSE least(0.5 + 0.2 * CAST(length({_T}) > 100 AS INT) + 0.2 * CAST({_SECTIONS} AS INT) + 0.1 * CAST(source IS NOT NULL AS INT), 1.0) END + {_COHERENCE})::DOUBLE / 3) / 3, 6) AS quality FROM documents""",
    "char_diversity": f"SELECT doc_id, len(list_distinct(list_filter(string_split({_T}, ''), lambda c: c <> ''))) AS n_distinct FROM documents",
    "hashes": f"SELECT doc_id, md5({_T}) AS md5, sha1({_T}) AS sha1, sha256({_T}) AS sha256, 'model:' || substr(sha256({_T}), 1, 16) AS cache_key FROM documents",
    "valid_docs": f"SELECT doc_id, length({_strip(_T)}) >= 10 AND source IS NOT NULL AS valid, CASE WHEN length({_strip(_T)}) < 10 THEN 'too_short' WHEN source IS NULL THEN 'no_source' END AS error_code FROM documents",
    "truncate": f"SELECT doc_id, CASE WHEN length({_T}) > 100 THEN left({_T}, 97) || '...' ELSE {_T} END AS short, length(left({_T}, 4000)) AS context_length FROM documents",
    "redact": f"SELECT doc_id, CASE WHEN length(r) > 200 THEN left(r, 197) || '...' ELSE r END AS logged FROM (SELECT doc_id, CASE WHEN regexp_matches(lower({_T}), 'password|token|key|secret') THEN '[REDACTED]' ELSE {_T} END AS r FROM documents)",
    "sentences": f"""SELECT doc_id, count(*) AS n_sentences, sum(length(s)) AS n_chars, max(length(s)) AS longest FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex({_T}, '[.!?]+(?:[ \\t\\n\\r\\f]+|$)'), lambda p: {_strip('p')}), lambda p: length(p) > 10)) AS s FROM documents) GROUP BY doc_id""",
    "doc_title": f"SELECT doc_id, ({_TITLE})[1] AS title FROM documents",
    "normalize": f"SELECT doc_id, sha256(o) AS sha, length(U) AS before, length(o) AS after FROM (SELECT doc_id, U, {_NORMAL} AS o FROM (SELECT doc_id, {_TEXT_UNRULY} AS U FROM documents))",
    "contractions": f"SELECT doc_id, length(o) AS n_chars, sha256(o) AS sha FROM (SELECT doc_id, {_CONTRACT} AS o FROM documents)",
    "title_case": f"SELECT doc_id, sha256(o) AS sha, {_n('loud', '[A-Z]')} - {_n('o', '[A-Z]')} AS n_lowered FROM (SELECT doc_id, loud, {_TITLED} AS o FROM (SELECT doc_id, {_LOUD} AS loud FROM documents))",
    "safe_filename": "SELECT page_id, left(translate(url, '<>:\"/\\|?*', '_________'), 255) AS name FROM pages",
    "html_to_text": f"SELECT page_id, length(t) AS n_chars, sha256(t) AS sha FROM (SELECT page_id, {_HTML} AS t FROM pages)",
    "html_security": f"SELECT page_id, contains(lower(html), '<script') AS script, contains(html, 'bit.ly') OR contains(html, 'tinyurl') AS shortened_url, contains(lower(html), '<script') OR contains(lower(html), 'javascript:') OR contains(lower(html), 'vbscript:') AS embedded_code, {_n('html', K.URL)} AS external_links FROM pages",
    "valid_urls": f"SELECT page_id, regexp_matches(url, '{URL_OK}') AS valid FROM pages",
    "url_domain": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages",
    "source_meta": r"""SELECT page_id, path, regexp_extract(path, '[^/]*$', 0) AS filename, lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '\.([^.]*)$', 1)) AS extension, octet_length(encode(coalesce(html, ''))) AS n_bytes,
        md5(concat_ws(':', url, sha256(coalesce(html, '')))) AS document_id FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
}
