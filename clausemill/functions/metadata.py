"""Semi-structured metadata as VARIANT: objects merged, counted and listed at any depth.

Expressions are unrolled to ``depth`` levels of nesting; deeper objects raise an error instead of
being cut. A JSON null is a value (a field that says nothing), a missing key isn't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import text as T

_TOO_DEEP = "metadata is nested deeper than {} levels"


def fields(v: Column) -> Column:
    """An object's fields as a map of variants; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def deep_merge(left: Column, right: Column, depth: int = 12) -> Column:
    """Two objects as one: where both have an object under a key these are merged, otherwise the
    right one's value wins. If either isn't an object the right one wins; a null side is the other."""
    if depth == 0:
        return F.when(fields(left).isNotNull() & fields(right).isNotNull(), F.raise_error(F.lit(_TOO_DEEP.format("as many"))).cast("variant")).otherwise(F.coalesce(right, left))
    both = fields(left).isNotNull() & fields(right).isNotNull()
    merged = F.map_zip_with(fields(left), fields(right), lambda k, x, y: F.when(x.isNotNull() & y.isNotNull(), deep_merge(x, y, depth - 1)).otherwise(F.coalesce(y, x)))
    return F.when(both, F.to_variant_object(merged)).otherwise(F.coalesce(right, left))


def leaf_count(v: Column, depth: int = 12) -> Column:
    """Fields of an object that aren't objects themselves, at any level; lists count as one."""
    def inner(x: Column, d: int) -> Column:
        if d == 0:
            return F.when(fields(x).isNotNull(), F.raise_error(F.lit(_TOO_DEEP.format(depth))).cast("long")).otherwise(F.lit(1).cast("long"))
        total = F.aggregate(F.map_values(fields(x)), F.lit(0).cast("long"), lambda n, y: n + inner(y, d - 1))
        return F.when(fields(x).isNotNull(), total).otherwise(F.lit(1).cast("long"))

    return F.when(fields(v).isNotNull(), inner(v, depth))


def leaves(v: Column, depth: int = 12) -> Column:
    """array<struct<path, value>> of the same fields: the path from ``$`` and the value as JSON."""
    def inner(x: Column, path: Column, d: int) -> Column:
        leaf = F.array(F.struct(path.alias("path"), F.to_json(x).alias("value")))
        if d == 0:
            return F.when(fields(x).isNotNull(), F.raise_error(F.lit(_TOO_DEEP.format(depth))).cast("array<struct<path:string,value:string>>")).otherwise(leaf)
        below = F.flatten(F.transform(F.map_entries(fields(x)), lambda e: inner(e["value"], F.concat(path, F.lit("."), e["key"]), d - 1)))
        return F.when(fields(x).isNotNull(), below).otherwise(leaf)

    return F.when(fields(v).isNotNull(), inner(v, F.lit("$"), depth))


def structure_flags(counts: Column) -> dict[str, Column]:
    """Headings, two or more levels' worth of them, lists and tables: whether ``structure_counts``
    has any."""
    return {"has_headings": counts["heading_lines"] > 0, "is_hierarchical": counts["heading_lines"] >= 2, "has_lists": counts["list_lines"] > 0, "has_tables": counts["table_lines"] > 0}


def probes(content: Column) -> dict[str, Column]:
    """Compression, PDF version and encoding, from a file's bytes."""
    head = F.decode(F.substring(content, 1, 16), "ISO-8859-1")
    version = F.regexp_extract(head, r"^%PDF-(\d+\.\d+)", 1)
    utf8 = F.is_valid_utf8(content.cast("string"))
    ascii_only = F.length(content) == F.length(F.regexp_replace(F.decode(content, "ISO-8859-1"), "[^\\x00-\\x7F]", ""))
    return {"compression": F.when(F.startswith(head, F.lit("PK")), "zip").otherwise("none"), "format_version": F.when(version != "", version),
            "encoding": F.when(F.startswith(head, F.lit("PK")) | F.startswith(head, F.lit("%PDF")), "binary").when(ascii_only, "ascii").when(utf8, "utf-8").otherwise("unknown")}


def text_counts(text: Column) -> dict[str, Column]:
    """What several groups of ``document`` need, to be columns of the rows that it is made of, so
    that each is counted once."""
    return {"words": T.word_count(text), "sentences": T.part_count(text, "."), "paragraphs": T.part_count(text, "\n\n"), "lines": T.structure_counts(text), "coherence": T.coherence(text)}


def document(text: Column, source: Column, language: Column, sections: Column, has_metadata: Column, counts: dict[str, Column] | None = None, ease: Column | None = None) -> Column:
    """All that is known of a text, in eight groups, as one VARIANT. ``counts`` (``text_counts``) and
    ``ease`` (``readability``) spare work where they are columns already."""
    group = lambda d: F.struct(*[c.alias(k) for k, c in d.items()])
    counts = text_counts(text) if counts is None else counts
    words, sentences = counts["words"], counts["sentences"]
    ease = T.readability(text, words, sentences) if ease is None else ease
    return F.to_variant_object(group({
        "source": F.struct(source.alias("name"), language.alias("language")),
        "document": group(T.statistics(text, words, sentences, counts["paragraphs"])),
        "content_analysis": F.struct(T.language(text, words).alias("language"), ease.alias("readability"), group(T.pattern_counts(text)).alias("patterns"), group(T.sentiment(text)).alias("tone")),
        "technical": F.struct(F.octet_length(text).alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha256")),
        "structure": group(structure_flags(counts["lines"])),
        "security": group(T.html_security(text)),
        "quality": F.struct(T.quality_score(text, sections, has_metadata, ease["flesch"], counts["coherence"]).alias("score"), counts["coherence"].alias("coherence")),
        "accessibility": F.struct(T.simple_readability(text, words, sentences).alias("simple_readability"), ease["reading_level"].alias("reading_level")),
    }))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _count(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "long") for p in paths], F.lit(0).cast("long"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")), F.lit(0))


def format_specific(kind: Column, meta: Column) -> Column:
    """The part of a scan's metadata that belongs to its format, with what it lacks filled in; null
    for other formats."""
    pdf = F.struct(F.coalesce(_text(meta, "$.pdf_metadata.Producer"), F.lit("Unknown")).alias("pdf_version"), _count(meta, "$.page_count").alias("page_count"), (_count(meta, "$.images_detected") > 0).alias("has_images"), (_count(meta, "$.tables_detected") > 0).alias("has_tables"),
                   *[_text(meta, f"$.pdf_metadata.{key}").alias(name) for name, key in K.PDF_FIELDS.items()])
    docx = F.struct(*[_text(meta, f"$.document_properties.{key}").alias(key) for key in K.DOCX_PROPERTIES], *[_count(meta, f"$.{key}").alias(key) for key in K.DOCX_COUNTS], F.coalesce(F.try_variant_get(meta, "$.styles_used", "array<string>"), F.array().cast("array<string>")).alias("styles_used"))
    mail = F.struct(*[_text(meta, f"$.headers.{key}").alias(name) for name, key in K.MAIL_FIELDS.items()], *[F.coalesce(F.try_variant_get(meta, f"$.structure.{key}", "boolean"), F.lit(False)).alias(name) for name, key in K.MAIL_FLAGS.items()], _items(meta, "$.attachments").alias("attachment_count"))
    return F.when(kind == "pdf", F.to_variant_object(pdf)).when(kind == "docx", F.to_variant_object(docx)).when(kind == "email", F.to_variant_object(mail))


def embedded(text: Column, meta: Column) -> dict[str, Column]:
    """Numbers of embedded objects: counted ones, else those a scan came upon."""
    return {"images": _count(meta, "$.images_count", "$.images_detected"), "tables": _count(meta, "$.tables_count", "$.tables_detected"), "hyperlinks": T.count(text, K.URL), "attachments": _items(meta, "$.attachments")}
