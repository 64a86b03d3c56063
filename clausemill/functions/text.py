"""Column functions on text: words, counts, readability, patterns, normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import constants as K

#: Blanks that every engine's regexes agree on.
_BLANKS = r"[ \t\n\r\f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it: the optimiser
    neither copies nor folds back what a lambda binds."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space at either end; trim() takes a set of characters in linear time."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+"))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def nonblank_parts(text: Column, separator: str) -> Column:
    """Parts between literal separators that hold more than white space, stripped."""
    parts = F.split(text, "\\Q" + separator + "\\E" if separator.strip() else separator)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def part_count(text: Column, separator: str) -> Column:
    return F.size(nonblank_parts(text, separator))


def statistics(text: Column, words: Column | None = None, sentences: Column | None = None, paragraphs: Column | None = None) -> dict[str, Column]:
    """Counts of words, sentences, paragraphs and lines, and their averages. The average
    sentence is over all parts between dots, blank ones too. Here and below, counts that are known
    already are taken as given."""
    w = word_count(text) if words is None else words
    paragraphs = part_count(text, "\n\n") if paragraphs is None else paragraphs
    return {
        "n_chars": F.length(text), "n_words": w, "n_sentences": part_count(text, ".") if sentences is None else sentences, "n_paragraphs": paragraphs, "n_lines": part_count(text, "\n"),
        "words_per_sentence": w / F.greatest(F.size(F.split(text, "\\.")), F.lit(1)), "words_per_paragraph": w / F.greatest(paragraphs, F.lit(1)),
    }


def character_counts(text: Column) -> dict[str, Column]:
    keep = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return {
        "total": F.length(text), "alphabetic": keep(r"[^\p{L}]+"), "numeric": keep(r"[^\p{Nd}]+"), "white_space": keep(r"[^ \t\n\r\f]+"),
        "punctuation": keep(r"[^.,;:!?]+"), "special": keep(r"[\p{L}\p{N} \t\n\r\f]+"),
    }


def present(text: Column, needles: list[str]) -> Column:
    """How many of the (lower-case) needles the text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(n)).cast("int") for n in needles])


def language(text: Column, words: Column | None = None) -> Column:
    """struct(language, indicators, confidence) by the presence of common words between spaces;
    English wins ties, and empty text is unknown."""
    lists = {"en": K.ENGLISH_WORDS, "es": K.SPANISH_WORDS, "fr": K.FRENCH_WORDS}

    def choose(c):
        english, spanish = (c["en"] >= c["es"]) & (c["en"] >= c["fr"]), c["es"] >= c["fr"]
        n = F.when(english, c["en"]).when(spanish, c["es"]).otherwise(c["fr"])
        name = F.when(c["empty"], "unknown").when(english, "english").when(spanish, "spanish").otherwise("french")
        sure = F.least(n / F.greatest(c["w"] * 0.1, F.lit(1.0)), F.lit(1.0))
        return F.struct(name.alias("language"), F.when(c["empty"], 0).otherwise(n).alias("indicators"), F.when(c["empty"], 0.0).otherwise(sure).alias("confidence"))

    counts = let(_spaced_words(text, lists), lambda hits: F.struct(*[_among(hits, ws).alias(k) for k, ws in lists.items()], (F.length(text) == 0).alias("empty"), (word_count(text) if words is None else words).alias("w")))
    return let(counts, choose)


def _spaced_words(text: Column, lists: dict[str, list[str]]) -> Column:
    """Those of the lists' words that stand between spaces or at an end of the lower-cased text."""
    every = sorted({w for ws in lists.values() for w in ws})
    return F.array_intersect(F.array(*[F.lit(w) for w in every]), F.split(F.lower(text), " "))


def _among(hits: Column, needles: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in needles]), lambda w: F.array_contains(hits, w)))


#: A word's first vowels with what is before them; a word without a vowel; later vowels with the
#: consonants before them, unless a final e ends them. Each place is looked at a bounded number of times.
_SYLLABLE = (r"(?<![^ \t\n\r\f])[^aeiouy \t\n\r\f]*+(?:[aeiouy]++|(?<=[^ \t\n\r\f])(?![^ \t\n\r\f]))"
             r"|(?<=[aeiouy])[^aeiouy \t\n\r\f]++(?![aeiouy]*e(?![^ \t\n\r\f]))[aeiouy]++")


def syllable_total(text: Column) -> Column:
    """Over all words: vowel groups, less one that ends in a final e where there are several, at
    least one."""
    return count(F.lower(text), _SYLLABLE)


def readability(text: Column, words: Column | None = None, sentences: Column | None = None) -> Column:
    """struct(flesch, reading_level): the reading ease and its band; 0 and unknown without words
    or sentences."""
    def ease(x):
        some = (x["w"] > 0) & (x["s"] > 0)
        return F.struct(some.alias("some"), F.when(some, 206.835 - 1.015 * (x["w"] / x["s"]) - 84.6 * (x["y"] / x["w"])).otherwise(0.0).alias("flesch"))

    counts = F.struct((word_count(text) if words is None else words).alias("w"), (part_count(text, ".") if sentences is None else sentences).alias("s"), syllable_total(text).alias("y"))
    return let(let(counts, ease), lambda x: F.struct(x["flesch"].alias("flesch"), F.when(~x["some"], "unknown").otherwise(_band(x["flesch"])).alias("reading_level")))


def _band(score: Column) -> Column:
    out = F.when(score >= K.READING_LEVELS[0][0], K.READING_LEVELS[0][1])
    for least, name in K.READING_LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("very_difficult")


def simple_readability(text: Column, words: Column | None = None, sentences: Column | None = None) -> Column:
    """1 less words a sentence over 20 and characters a word over 10, from 0 to 1."""
    w = word_count(text) if words is None else words
    s = part_count(text, ".") if sentences is None else sentences
    chars = F.length(F.regexp_replace(text, _BLANKS, ""))
    return F.when((w > 0) & (s > 0), F.greatest(F.lit(0.0), 1 - F.least(w / s / 20 + chars / w / 10, F.lit(1.0)))).otherwise(0.0)


def coherence(text: Column) -> Column:
    """0.8 where sentences have 5 to 30 words on average, else 0.5; 0 without sentences."""
    counts = let(nonblank_parts(text, "."), lambda ps: F.struct(F.size(ps).alias("s"), F.aggregate(ps, F.lit(0).cast("long"), lambda a, x: a + word_count(x)).alias("w")))
    return let(counts, lambda x: F.when(x["s"] == 0, 0.0).when((x["w"] / x["s"]).between(5, 30), 0.8).otherwise(0.5))


def quality_score(text: Column, sections: Column, has_metadata: Column, flesch: Column | None = None, coherent: Column | None = None) -> Column:
    """Mean of completeness, clarity and accuracy; the reading ease enters unclamped."""
    n = lambda c: c.cast("double")
    long_enough = F.length(text) > 100
    several = sections > 1
    complete = (n(strip(text) != "") + n(long_enough) + n(several) + n(F.length(strip(text)) >= 10)) / 4
    clear = ((readability(text)["flesch"] if flesch is None else flesch) / 100 + 1 + n(several)) / 3
    confident = F.when(F.length(text) == 0, 0.0).otherwise(F.least(0.5 + 0.2 * n(long_enough) + 0.2 * n(several) + 0.1 * n(has_metadata), F.lit(1.0)))
    return (complete + clear + (1.0 + confident + (coherence(text) if coherent is None else coherent)) / 3) / 3


def pattern_counts(text: Column) -> dict[str, Column]:
    counts = {name: count(text, p) for name, p in K.CONTENT_PATTERNS.items()}
    return counts | {"emails": F.when(F.contains(text, F.lit("@")), counts["emails"]).otherwise(0)}


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def sentiment(text: Column) -> dict[str, Column]:
    t = F.lower(text)
    return {"positive": present(t, K.POSITIVE_WORDS), "negative": present(t, K.NEGATIVE_WORDS), "urgent": present(t, K.URGENT_WORDS)}


def structure_counts(text: Column) -> Column:
    """struct of the numbers of heading-like, list and table lines; the text is split once."""
    bars = lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    table = lambda s: ((F.size(words(s)) >= 3) & F.contains(s, F.lit("   "))) | (F.size(F.split(s, "\t")) >= 3) | (bars(s) >= 2)
    kinds = {"heading_lines": lambda s: matches_any(strip(s), K.HIERARCHY_PATTERNS), "list_lines": lambda s: matches_any(s, K.LIST_PATTERNS), "table_lines": table}
    return let(F.split(text, "\n"), lambda lines: F.struct(*[F.size(F.filter(lines, p)).alias(k) for k, p in kinds.items()]))


def distinct_characters(text: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))


def normalise(text: Column) -> Column:
    """Control characters out, line ends, Unicode spaces, runs of spaces, quotes and dashes
    settled, in that order. Composition (NFC) is ``nfc``, for it has no built-in function."""
    t = F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    for chars, to in ((K.UNICODE_SPACES, " "), (None, None), (K.DOUBLE_QUOTES, '"'), (K.SINGLE_QUOTES, "'"), (K.DASHES, "-")):
        t = F.regexp_replace(t, f"[{chars}]", to) if chars else F.regexp_replace(t, " {2,}", " ")
    return t


def nfc(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return run(text)


def with_nfc(rows: DataFrame, name: str = "text") -> DataFrame:
    """``rows`` with the column ``name`` composed. ASCII texts don't go to Python, and others in small batches."""
    scratch.bound_batches(rows.sparkSession)
    t = F.col(name)
    return rows.withColumn(name, F.coalesce(nfc(F.when(F.octet_length(t) > F.length(t), t)), t))


def expand_contractions(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), K.CONTRACTIONS, text)


def title_case_lines(text: Column) -> Column:
    """All-capitals lines of at most ten words without digits in title case."""
    caps = lambda s: (F.upper(s) == s) & (F.lower(s) != s) & (F.size(words(s)) <= 10) & ~s.rlike("[0-9]")
    return F.array_join(F.transform(F.split(text, "\n"), lambda s: F.when(caps(s), F.initcap(F.lower(s))).otherwise(s)), "\n")


ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_to_text(html: Column) -> Column:
    """Tags out, common entities resolved, white space collapsed; script bodies stay."""
    t = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.regexp_replace(html, "<[^>]+>", ""))
    return F.trim(F.regexp_replace(t, _BLANKS, " "))


def html_security(html: Column) -> dict[str, Column]:
    t = F.lower(html)
    return {"script": F.contains(t, F.lit("<script")), "shortened_url": F.contains(html, F.lit("bit.ly")) | F.contains(html, F.lit("tinyurl")),
            "embedded_code": F.contains(t, F.lit("<script")) | F.contains(t, F.lit("javascript:")) | F.contains(t, F.lit("vbscript:")), "external_links": count(html, K.URL)}


def safe_filename(name: Column) -> Column:
    return F.left(F.translate(name, '<>:"/\\|?*', "_" * 9), F.lit(255))


def truncate(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - len(suffix))), F.lit(suffix))).otherwise(text)


def redact(text: Column) -> Column:
    return F.when(F.lower(text).rlike("password|token|key|secret"), "[REDACTED]").otherwise(text)


def sentences(text: Column, least: int = 10) -> Column:
    """Parts between sentence ends (a run of .!? before white space or the end), stripped, of
    more than ``least`` characters; the ends themselves are dropped."""
    return F.filter(F.transform(F.split(text, r"[.!?]+(?:[ \t\n\r\f]+|$)"), strip), lambda s: F.length(s) > least)


def language_or(known: Column, text: Column) -> Column:
    """The language a document brings, else a guess by the shorter lists; unknown without a hit."""
    lists = (K.ENGLISH_WORDS_SHORT, K.SPANISH_WORDS_SHORT, K.FRENCH_WORDS_SHORT)
    counts = let(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), lambda t: F.struct(*[present(t, [f" {w} " for w in ws]).alias(k) for k, ws in zip(("en", "es", "fr"), lists)]))
    guess = let(counts, lambda c: F.when((c["en"] >= c["es"]) & (c["en"] >= c["fr"]), "english").when(c["es"] >= c["fr"], "spanish").when(c["fr"] > 0, "french").otherwise("unknown"))
    return F.coalesce(known, guess)


def mail_language(text: Column) -> Column:
    """A guess for mail bodies by common words anywhere in the text, within longer words too;
    English wins ties, then Spanish; empty or null text is unknown."""
    lists = (K.MAIL_ENGLISH_WORDS, K.MAIL_SPANISH_WORDS, K.MAIL_FRENCH_WORDS)
    counts = let(F.lower(text), lambda t: F.struct(*[present(t, ws).alias(k) for k, ws in zip(("en", "es", "fr"), lists)]))
    guess = let(counts, lambda c: F.when((c["en"] >= c["es"]) & (c["en"] >= c["fr"]), "english").when(c["es"] >= c["fr"], "spanish").otherwise("french"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, guess).otherwise("unknown")


def logged_list(items: Column, most: int = 10, length: int = 200) -> Column:
    """The first ``most`` items, each redacted and cut to ``length`` as a log line is."""
    return F.transform(F.slice(items, 1, most), lambda s: truncate(redact(s), length))


def changes(text: Column) -> Column:
    """struct(counts, length): what ``normalise`` changes, step by step, as characters removed or
    replaced, and the length that it leaves (its last steps put one character for one). Each step is
    made once."""
    def from_clean(t):
        return let(F.regexp_replace(t, r"\r\n?", "\n"), lambda lined: from_lined(t, lined))

    def from_lined(t, lined):
        return let(F.regexp_replace(lined, f"[{K.UNICODE_SPACES}]", " "), lambda spaced: let(F.length(F.regexp_replace(spaced, " {2,}", " ")), lambda n: facts(t, lined, spaced, n)))

    def facts(t, lined, spaced, n):
        counts = F.struct(
            (F.length(text) - F.length(t)).alias("control_characters"), count(t, r"\r\n?").alias("line_endings"), count(lined, f"[{K.UNICODE_SPACES}]").alias("white_space"),
            (F.length(spaced) - n).alias("extra_spaces"), count(t, f"[{K.DOUBLE_QUOTES}{K.SINGLE_QUOTES}]").alias("quotes"), count(t, f"[{K.DASHES}]").alias("dashes"))
        return F.struct(counts.alias("counts"), n.alias("length"))

    return let(F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", ""), from_clean)


def change_counts(text: Column) -> Column:
    return changes(text)["counts"]


def hyperlinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.URL), F.lit(0))


def numbered_references(text: Column) -> Column:
    """n of [n] and (n), in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\d+\]|\(\d+\)"), F.lit(0)), lambda r: F.substring(r, F.lit(2), F.length(r) - 2))


def suspicious_links(text: Column) -> Column:
    """Links by way of shorteners or to dotted quads, each once."""
    return F.filter(hyperlinks(text), lambda u: reduce(lambda a, b: a | b, [F.contains(F.lower(u), F.lit(s)) for s in K.SHORTENERS]) | u.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"))


def sentence_count(text: Column) -> Column:
    """Parts between runs of sentence ends that aren't blank, of any length."""
    return F.size(F.filter(F.split(text, "[.!?]+"), lambda p: strip(p) != ""))


def duration_label(seconds: Column) -> Column:
    """Milliseconds under a second, seconds under a minute, else minutes and seconds."""
    tenth = lambda c: F.format_string("%.1f", F.round(c, 1))
    return (F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("long").cast("string"), F.lit("ms"))).when(seconds < 60, F.concat(tenth(seconds), F.lit("s")))
            .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), tenth(seconds % 60), F.lit("s"))))


def merged(left: Column, right: Column, prefix: str = "") -> Column:
    """Two maps as one; keys of the right, with ``prefix``, win."""
    right = F.transform_keys(right, lambda k, v: F.concat(F.lit(prefix), k)) if prefix else right
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def question_fault(q: Column) -> Column:
    """Why a question can't be asked: blank, or over 500 characters; null if it can."""
    return F.when(F.coalesce(strip(q), F.lit("")) == "", "empty").when(F.length(q) > 500, "too_long")
