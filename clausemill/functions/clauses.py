"""Column functions on clause texts: numbering, structure, type, references, terms."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import let, strip


def first_of(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern, in order, that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def numbering(text: Column) -> Column:
    return F.when(text.rlike(K.NUMBERING_START), first_of(strip(text), K.NUMBERINGS))


def numbered_rest(text: Column) -> Column:
    return F.when(text.rlike(K.NUMBERING_START), F.trim(first_of(strip(text), K.NUMBERINGS, 2)))


def structure_type(text: Column) -> Column:
    """What a text is: by keyword, by how it begins, by its numbering, else by its length."""
    return let(numbering(text), lambda n: structure_kind(text, n))


def structure_kind(text: Column, number: Column) -> Column:
    """``structure_type`` of a text whose ``numbering`` is known."""
    def by_start(low):
        starts = lambda *ws: reduce(lambda a, b: a | b, [F.startswith(low, F.lit(w)) for w in ws])
        has = lambda w: F.contains(low, F.lit(w))
        return F.when(starts("whereas", "recital"), "recital").when(starts("preamble"), "preamble").when(has("signature") & (has("date") | has("sign")), "signature_block").when(starts("schedule", "appendix", "exhibit"), "schedule")

    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    out = F.when(text.rlike(K.STRUCTURES[0][1]), K.STRUCTURES[0][0])
    for name, p in K.STRUCTURES[1:]:
        out = out.when(text.rlike(p), name)
    numbered = F.when(number.isNotNull(), F.when(dots > 1, "subclause").when(dots > 0, "clause").when(F.length(numbered_rest(text)) > 200, "section").otherwise("subsection"))
    # keywords are looked for only where a text may begin with one
    named = F.when(text.rlike(K.STRUCTURE_START), out)
    return F.coalesce(named, let(F.lower(strip(text)), by_start), numbered, F.when(F.length(text) < 100, "heading").when(F.length(text) < 500, "paragraph").otherwise("section"))


def _count(low: pa.Array, pattern: str) -> np.ndarray:
    """How often a pattern matches; only texts with a match are counted, an anchored one matches once."""
    has = pc.fill_null(pc.match_substring_regex(low, pattern), False)
    out = has.to_numpy(zero_copy_only=False).astype(np.int32)
    if not pattern.startswith("^") and out.any():
        out[out > 0] = pc.count_substring_regex(low.filter(has), pattern).to_numpy(zero_copy_only=False)
    return out


def types_of(texts: pa.Array) -> pa.StructArray:
    """(clause_type, hits) of texts: the type with most indicator hits, the first declared on ties;
    other without a hit. Arrow matches a whole batch by automata, in linear time, where a
    backtracking expression for each of the 27 patterns is an order slower."""
    low = pc.utf8_lower(texts)
    hits = np.stack([sum(_count(low, p) for p in ps) for ps in K.CLAUSE_INDICATORS.values()])
    most = hits.max(axis=0)
    names = pa.array([*K.CLAUSE_INDICATORS, "other"])
    return pa.StructArray.from_arrays([names.take(pa.array(np.where(most > 0, hits.argmax(axis=0), len(names) - 1))), pa.array(most)], names=["clause_type", "hits"])


def reads_like_clause(texts: pa.Array) -> pa.BooleanArray:
    """Whether texts of 50 to 2,000 characters match two of the patterns or more; null for null."""
    low = pc.utf8_lower(texts)
    hits = reduce(pc.add, [pc.match_substring_regex(low, p).cast(pa.int32()) for p in K.LIKELY_CLAUSE])
    n = pc.utf8_length(texts)
    return pc.and_(pc.greater_equal(hits, 2), pc.and_(pc.greater_equal(n, 50), pc.less_equal(n, 2000)))


def type_and_confidence(text: Column) -> Column:
    """struct(clause_type, confidence) of a clause; the confidence is hits over one and the length
    in thousands, at most 1, and 0.5 without a hit."""
    @F.arrow_udf("struct<clause_type: string, hits: int>")
    def run(texts: pa.Array) -> pa.Array:
        return types_of(texts)

    b = run(text)
    return F.struct(b["clause_type"].alias("clause_type"), F.when(b["hits"] > 0, F.least(b["hits"] / (F.length(text) / 1000 + 1), F.lit(1.0))).otherwise(0.5).alias("confidence"))


def _set(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))


def references(text: Column) -> Column:
    """Sections, parts and schedules named, and words for places in the text. A pattern is tried only
    where the lower-cased text has one of its words."""
    some = let(F.lower(text), lambda low: F.array(*[reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws]) for ws in K.REFERENCE_WORDS]))
    return let(some, lambda has: _set(*[F.when(~has[i], F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(p), F.lit(g))) for i, (p, g) in enumerate(K.REFERENCES)]))


_TERMS = "|".join(p.removeprefix(r"\b(?:").removesuffix(r")\b") for p in K.KEY_TERMS).split("|")
#: ``KEY_TERMS`` as one pattern: no word stands in terms of two of them, so that one pass finds what a pass for
#: each finds. Terms are tried only where a word has the first letter of one.
_TERM = rf"\b(?=[{''.join(sorted({t[0] for t in _TERMS}))}])(?:{'|'.join(_TERMS)})\b"


def key_terms(text: Column) -> Column:
    """Legal terms, quoted terms and runs of capitals."""
    return _set(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z\s]{2,}\b"), F.lit(0)))


def likely_clause(text: Column) -> Column:
    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return reads_like_clause(texts)

    return run(text)


def section_level(line: Column) -> Column:
    """Dots of the numbering and one; without one by keyword, else 4."""
    return let(numbering(line), lambda n: level_of(line, n))


def level_of(line: Column, number: Column) -> Column:
    """``section_level`` of a line whose ``numbering`` is known."""
    def by_word(low):
        has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws])
        return F.when(has("article", "chapter", "part"), 1).when(has("section"), 2).when(has("clause"), 3).otherwise(4)

    return F.when(number.isNotNull(), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(let(F.lower(line), by_word))
