"""Chunks of texts: fixed size, sentences, paragraphs, sections, and their links and quality."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .structure import by_text, headed, headings, paragraphs, sections


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters."""

    max_size: int = 1000
    min_size: int = 100
    overlap: int = 50

    def __post_init__(self):
        if not 0 <= self.overlap < self.max_size or self.min_size >= self.max_size:
            raise ValueError("sizes must satisfy min < max and 0 <= overlap < max")


def fixed_spans(length: Column, c: ChunkConfig) -> Column:
    """(k, s, e) of windows of ``max_size`` that step by ``max_size - overlap``; the last one
    ends with the text."""
    step = c.max_size - c.overlap
    n = F.when(length <= c.max_size, 1).otherwise(F.ceil((length - c.max_size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), (k * step).alias("s"), F.least(k * step + c.max_size, length).alias("e")))


def fixed(docs: DataFrame, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_id, k, start, end, content) of fixed windows; blank texts give none."""
    # windows are cut before they are rows: an exploded row would carry the whole text
    cut = F.transform(fixed_spans(F.length("text"), c), lambda w: F.struct(w["k"].alias("k"), w["s"].alias("start"), w["e"].alias("end"), F.substring("text", w["s"] + 1, w["e"] - w["s"]).alias("content")))
    return docs.filter(X.strip(F.col("text")) != "").select("doc_id", F.explode(cut).alias("w")).select("doc_id", "w.*")


def snapped(docs: DataFrame, c: ChunkConfig = ChunkConfig(), back: int = 200) -> DataFrame:
    """(doc_id, k, start, end, content) of windows that end behind the last sentence end in their
    last ``back`` characters, or where they are full if there is none. The next one starts
    ``overlap`` characters earlier; the last ends with the text. ``back`` and ``overlap`` must leave
    a window some room, so that each one gets on."""
    if c.max_size <= back + c.overlap:
        raise ValueError("max_size must exceed back + overlap")
    rows = docs.filter(X.strip(F.col("text")) != "").select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, k) for n, k in (("k", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("content", T.StringType()))]])

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):  # a text's windows at a time
                spans = list(_snapped_spans(text, c, back))
                ids = pa.array([batch.column("doc_id")[i].as_py()] * len(spans), batch.schema.field("doc_id").type)
                yield pa.record_batch([ids, pa.array(range(len(spans)), pa.int32()), *[pa.array([x[j] for x in spans], pa.int32()) for j in (0, 1)], pa.array([text[s:e] for s, e in spans], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


_SENTENCE_END = re.compile(r"(?s)(.*[.!?])[ \t\n\x0b\f\r]")


def _snapped_spans(text: str, c: ChunkConfig, back: int) -> Iterator[tuple[int, int]]:
    """The windows of one text. Each depends on the end of the one before; a window looks at its last
    ``back`` characters alone, so the time is linear in the text."""
    at, n, e = 0, len(text), -1
    while e < n:
        e = full = min(at + c.max_size, n)
        if full < n and (m := _SENTENCE_END.match(text[full - back : full + 1])):
            e = full - back + m.end(1)
        yield at, e
        at = e - c.overlap


def long_boundaries(text: Column, size: int = 3000, step: int = 2500) -> Column:
    """Boundaries of a long text by way of overlapping segments: each one's own boundaries, moved
    to their place in the text, each once and sorted."""
    def found(t):
        at = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(step))
        # each segment is bound: its length is asked for at every boundary
        return F.flatten(F.transform(at, lambda s: X.let(F.substring(t, s + 1, F.lit(size)), lambda part: F.transform(fallback_boundaries(part), lambda b: b + s))))

    return F.array_sort(F.array_distinct(X.let(text, found)))


def coverage(docs: DataFrame, chunks: DataFrame, least: float = 0.8) -> DataFrame:
    """By document: whether chunk ids are unique and chunks cover ``least`` of the text."""
    sums = chunks.groupBy("doc_id").agg(F.sum(F.length("content")).alias("n"), F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk_id").alias("n_ids"))
    rows = docs.select("doc_id", F.length("text").alias("length")).join(sums, "doc_id", "left")
    share = F.when(F.col("length") > 0, F.coalesce("n", F.lit(0)) / F.col("length")).otherwise(1.0)
    return rows.select("doc_id", (F.coalesce("n_chunks", F.lit(0)) == F.coalesce("n_ids", F.lit(0))).alias("unique_ids"), F.round(share, 6).alias("share"), (share >= least).alias("covered"))


def page_of(positions: DataFrame, pages: DataFrame) -> DataFrame:
    """``positions`` (doc_id, position) with the number of the page (doc_id, page, start, end; end
    exclusive) that holds each; null if none does. Pages don't overlap. Positions and beginnings of
    pages are sorted together, and each position takes the last page that has begun: one sort by
    document, and no pairs of positions and pages."""
    begun = pages.filter("doc_id IS NOT NULL AND end > start").select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("page", F.col("end").alias("e")).alias("_page"))
    row = F.struct(*[F.col(c) for c in positions.columns])
    asked = positions.select("doc_id", F.col("position").alias("_at"), F.lit(1).alias("_kind"), row.alias("_row"))
    w = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(begun, allowMissingColumns=True).withColumn("_page", F.last("_page", ignorenulls=True).over(w)).filter("_kind = 1")
    return both.select("_row.*", F.when(F.col("_at") < F.col("_page.e"), F.col("_page.page")).alias("page"))


def _pack(parts: Column, limit: int, carry: int) -> Column:
    """Greedy lists of parts whose lengths sum to at most ``limit``; a full list passes its last
    ``carry`` parts on. Joiners don't count."""
    none = F.expr("cast(array() AS array<string>)")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    start = F.struct(F.expr("cast(array() AS array<array<string>>)").alias("done"), none.alias("cur"), F.lit(0).alias("size"))

    def step(acc, x):
        full = (acc["size"] + F.length(x) > limit) & (F.size(acc["cur"]) > 0)
        tail = F.slice(acc["cur"], F.greatest(F.size(acc["cur"]) - carry + 1, F.lit(1)), F.lit(carry)) if carry else none
        cur = F.when(full, F.concat(tail, F.array(x))).otherwise(F.concat(acc["cur"], F.array(x)))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), cur.alias("cur"), F.when(full, total(cur)).otherwise(acc["size"] + F.length(x)).alias("size"))

    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def by_sentences(docs: DataFrame, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_id, k, content): sentences packed greedily; the last ceil(overlap / 50) go on."""
    packed = _pack(X.sentences(F.col("text")), c.max_size, -(-c.overlap // 50))
    return docs.select("doc_id", F.posexplode(packed).alias("k", "parts")).select("doc_id", "k", F.array_join("parts", " ").alias("content"))


def by_paragraphs(docs: DataFrame, c: ChunkConfig = ChunkConfig(), separator: str = r"\n[ \t\n\r\f]*\n") -> DataFrame:
    """(doc_id, k, content): paragraphs packed greedily; the last goes on if there is overlap."""
    ps = F.filter(F.transform(F.split("text", separator), X.strip), lambda p: F.length(p) > 20)
    packed = _pack(ps, c.max_size, 1 if c.overlap else 0)
    return docs.select("doc_id", F.posexplode(packed).alias("k", "parts")).select("doc_id", "k", F.array_join("parts", "\n\n").alias("content"))


def by_sections(docs: DataFrame, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_id, start, end, title): a chunk a section, larger ones cut to fixed windows."""
    rows = sections(docs).select("doc_id", "title", "start", F.explode(fixed_spans(F.col("end") - F.col("start"), c)).alias("w"))
    return rows.select("doc_id", "title", (F.col("start") + F.col("w.s")).alias("start"), (F.col("start") + F.col("w.e")).alias("end"))


def hybrid(docs: DataFrame, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Sections; those above one and a half times the largest size are cut at the boundaries of
    their paragraphs, where pieces under the least size are left out. A text's sections are cut where
    the text lies: it meets them in no join."""
    def cut(text):
        for _, _, title, start, end, _ in headed(text):
            if end - start <= 1.5 * c.max_size:
                yield title, start, end
                continue
            edges = [start, *[start + b for b in _blank_bounds(text[start:end])], end]
            good = [x for x in zip(edges, edges[1:]) if x[1] - x[0] >= c.min_size]
            for s, e in good or [(start, end)]:
                yield title, s, e

    fields = [T.StructField("title", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    return by_text(docs.filter("doc_id IS NOT NULL"), fields, lambda text: list(cut(text)))


def _blank_bounds(text: str) -> list[int]:
    """``fallback_boundaries`` of one text."""
    return [b for b in accumulate(len(p) + 2 for p in text.split("\n\n")) if b < len(text)]


def boundary_spans(text: Column, boundaries: Column, least: int) -> Column:
    """(s, e) of the pieces between sorted boundaries that have ``least`` characters, or of the whole
    text if none has."""
    inner = F.array_sort(F.array_distinct(F.filter(boundaries, lambda b: (b > 0) & (b < F.length(text)))))
    edges = F.concat(F.array(F.lit(0)), inner, F.array(F.length(text)))

    def spans(es):
        all_ = F.transform(F.sequence(F.lit(1), F.size(es) - 1), lambda i: F.struct(F.get(es, i - 1).alias("s"), F.get(es, i).alias("e")))
        return F.filter(all_, lambda x: x["e"] - x["s"] >= least)

    return X.let(X.let(edges, spans), lambda good: F.when(F.size(good) > 0, good).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("e")))))


def at_boundaries(text: Column, boundaries: Column, least: int) -> Column:
    """The pieces that ``boundary_spans`` names."""
    return F.transform(boundary_spans(text, boundaries, least), lambda x: F.substring(text, x["s"] + 1, x["e"] - x["s"]))


def fallback_boundaries(text: Column) -> Column:
    """Running lengths of the parts between blank lines, two characters each between."""
    sums = F.aggregate(F.split(text, "\n\n"), F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<int>)").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p) + 2).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p) + 2)).alias("out")), lambda a: a["out"])
    return F.filter(sums, lambda b: b < F.length(text))


def parsed_boundaries(response: Column, length: Column) -> Column:
    """Numbers of a free-text response that lie inside the text, sorted."""
    ints = F.transform(F.regexp_extract_all(response, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(ints, lambda b: (b > 0) & (b < length))))


_BLANK = " \t\n\r\f\x0b"
_PIECES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())]))


def _pieces_of(text: str | None, bounds: list[int] | None, least: int) -> list[dict]:
    """Stripped pieces between the boundaries, or between blank lines if there are none given."""
    if text is None:
        return []
    if bounds is None:
        bounds = _blank_bounds(text)
    edges = [0, *bounds, len(text)]
    cut = ((a, b, text[a:b].strip(_BLANK)) for a, b in zip(edges, edges[1:]))
    return [{"start": a, "end": b, "content": c} for a, b, c in cut if len(c) >= least]


def semantic(docs: DataFrame, response: str = "response", least: int = 50) -> DataFrame:
    """Chunks between the boundaries that a model's free-text answer names, numbers outside the
    text left out; without an answer (null), between blank lines. Content is stripped, shorter
    chunks than ``least`` go, and a text may end up with none. Null texts have none. A text is cut
    in Arrow batches, in time that grows with its length alone: cutting by position in an
    expression starts from the text's beginning for each piece."""
    @F.arrow_udf("array<struct<start:int,end:int,content:string>>")
    def cut(texts: pa.Array, bounds: pa.Array) -> pa.Array:
        return pa.array([_pieces_of(t, b, least) for t, b in zip(texts.to_pylist(), bounds.to_pylist())], _PIECES)

    bounds = parsed_boundaries(F.col(response), F.length("text"))
    return docs.select("doc_id", F.posexplode(cut(F.col("text"), bounds)).alias("k", "p")).select("doc_id", "k", "p.start", "p.end", "p.content")


def chunk_id(doc: Column, start: Column, content: Column) -> Column:
    return F.concat_ws("_", doc.cast("string"), start.cast("string"), F.substring(F.md5(content.cast("binary")), 1, 8))


def context_label(content: Column, start: Column, end: Column, around: int) -> Column:
    """The content behind the span that it stands in with ``around`` characters on either side."""
    return F.concat(F.lit("[Context: "), F.greatest(start - around, F.lit(0)).cast("string"), F.lit("-"), (end + around).cast("string"), F.lit("] "), content)


def links(chunks: DataFrame, overlap: int = 50) -> DataFrame:
    """Ids of the chunks before and after, and how far chunks overlap those."""
    w = Window.partitionBy("doc_id").orderBy("start")
    before = F.lag("end").over(w) - F.col("start")
    after = F.col("end") - F.lead("start").over(w)
    return chunks.select("doc_id", "start", F.concat(F.lit("previous:"), F.lag("chunk_id").over(w)).alias("previous"), F.concat(F.lit("next:"), F.lead("chunk_id").over(w)).alias("next"),
                         F.greatest(F.lit(0), F.least(F.lit(overlap), F.coalesce(before, F.lit(0)))).alias("overlap_previous"), F.greatest(F.lit(0), F.least(F.lit(overlap), F.coalesce(after, F.lit(0)))).alias("overlap_next"))


def quality(chunks: DataFrame, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """By document: chunks, those too small, too large or repeated, and sizes."""
    n = F.length("content")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum((n < c.min_size).cast("long")).alias("n_small"), F.sum((n > 1.2 * c.max_size).cast("long")).alias("n_large"), (F.count(F.lit(1)) - F.countDistinct(F.md5(F.col("content").cast("binary")))).alias("n_repeated"),
                                        F.floor(F.avg(n)).alias("avg_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"))


def with_section(places: DataFrame, secs: DataFrame) -> DataFrame:
    """``places`` (doc_id, start and other columns) with ``section``, the title of the first section whose
    span holds each (both ends included), null if none.

    A section that ends no later than one before it never is the first to hold a place, so only
    those that reach further than all before count. Their beginnings and ends both rise: the first
    that holds a place is the next to end, if it has begun. So places and ends are sorted together,
    from the last to the first, without pairs of chunks and sections."""
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    far = secs.filter("doc_id IS NOT NULL").withColumn("_reach", F.max("end").over(before)).filter("_reach IS NULL OR end > _reach")
    ends = far.select("doc_id", F.col("end").alias("_at"), F.lit(1).alias("_kind"), F.struct(F.col("start").alias("s"), "title").alias("_sec"))
    asked = places.select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct(*[F.col(c) for c in places.columns]).alias("_row"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(ends, allowMissingColumns=True).withColumn("_sec", F.last("_sec", ignorenulls=True).over(w)).filter("_kind = 0")
    return both.select("_row.*", F.when(F.col("_sec.s") <= F.col("_at"), F.col("_sec.title")).alias("section"))


def containing_section(chunks: DataFrame, secs: DataFrame) -> DataFrame:
    """Each place (doc_id, start) of chunks once, ``with_section``."""
    return with_section(chunks.select("doc_id", "start").repartition("doc_id").distinct(), secs)


def text_overlap(a: Column, b: Column, most: int) -> Column:
    """Length of the longest end of ``a`` that begins ``b``, up to ``most``, in one pass: hashes of the end
    of ``a`` and the beginning of ``b`` grow a character at a time, and the last length at which they agree is
    compared. Only if that were a chance would all lengths be."""
    prime, base = 2_147_483_647, 1_000_003
    n = F.least(F.length(a), F.length(b), F.lit(most))
    codes = lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    zero = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("p", 1), ("x", 0), ("y", 0), ("i", 0), ("best", 0))])

    def step(acc, pair):
        x, y, i = (acc["x"] + pair["a"] * acc["p"]) % prime, (acc["y"] * base + pair["b"]) % prime, acc["i"] + 1
        return F.struct((acc["p"] * base % prime).alias("p"), x.alias("x"), y.alias("y"), i.alias("i"), F.when(x == y, i).otherwise(acc["best"]).alias("best"))

    def longest(n):
        pairs = F.zip_with(F.reverse(codes(F.right(a, n))), codes(F.left(b, n)), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
        best = F.aggregate(pairs, zero, step, lambda acc: acc["best"].cast("int"))
        every = F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.right(a, i) == F.left(b, i)))
        return X.let(best, lambda i: F.when(F.right(a, i) == F.left(b, i), i).otherwise(every))

    return F.coalesce(F.when(n > 0, X.let(n, longest)), F.lit(0))


def tune(docs: DataFrame, target: int = 10, min_size: int = 100, separator: str = "\n") -> DataFrame:
    """Sizes that suit each document: its length over ``target``, or three mean paragraphs."""
    mean = paragraphs(docs, separator).groupBy("doc_id").agg(F.floor(F.avg(F.length("content"))).alias("mean"))
    rows = docs.select("doc_id", F.floor(F.length("text") / target).alias("wanted")).join(mean, "doc_id", "left")
    best = F.when(F.col("mean") > 0, F.greatest(F.lit(min_size), F.least("wanted", F.col("mean") * 3))).otherwise(F.col("wanted"))
    return rows.select("doc_id", best.alias("max_size"), F.greatest(F.lit(50), F.floor(best / 10)).alias("min_size"), F.greatest(F.lit(25), F.floor(best / 20)).alias("overlap"))


def batches(items: Column, n: int) -> Column:
    """The list in batches of ``n``. The list is made once, not for every batch."""
    return X.let(items, lambda xs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(n)), lambda i: F.slice(xs, i, F.lit(n))))


STRATEGIES = {"fixed_size": fixed, "sentence_based": by_sentences, "paragraph_based": by_paragraphs, "structure_aware": by_sections, "hybrid": hybrid}


def chunk(docs: DataFrame, strategy: str = "fixed_size", c: ChunkConfig = ChunkConfig()) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    return STRATEGIES[strategy](docs.filter(X.strip(F.col("text")) != ""), c)


__all__ = ["ChunkConfig", "chunk", "headings"]
