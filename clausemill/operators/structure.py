"""Document structure: headings, paragraphs, lists, tables, sections."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clauses as C
from ..functions import constants as K
from ..functions import text as X
from ..sources import scratch


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_number, line)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))


_BLANK = " \t\n\r\f\x0b"
#: ``MARKDOWN_HEADING`` and ``NUMBERED_HEADING`` in one, with the classes of the other engines' regexes.
_HEADING = re.compile(r"(?:(#{1,6})|([0-9]+(?:\.[0-9]+)*\.?))[ \t\n\x0b\f\r]+([^\n\r\x85\u2028\u2029]+)\Z")
_HEAD_STARTS = frozenset("#0123456789")


def headed(text: str) -> list[tuple[int, int, str, int, int, int]]:
    """(line_number, level, title, start, end, n_words) of a text's headings and the sections below
    them, in order. Going from the last to the first, the open ones' levels rise, so the first that
    isn't deeper ends the section: linear time. A section is a run of lines, so its words are a
    difference of running sums."""
    heads, at = [], 0
    for i, raw in enumerate(text.split("\n")):
        line = raw.strip(_BLANK)
        if line and line[0] in _HEAD_STARTS and (m := _HEADING.match(line)) and (m[1] or len(line) < 100):
            heads.append((i, len(m[1]) if m[1] else m[2].count(".") + 1, m[3].strip(_BLANK), at))
        at += len(raw) + 1
    out, open_, end, words = [], [], len(text), 0
    for i, level, title, start in reversed(heads):
        words += len(text[start:end].replace("\x0b", "x").encode().split())  # a vertical tab is no blank between words
        end = start
        while open_ and open_[-1][0] > level:
            open_.pop()
        stop, after = open_[-1][1:] if open_ else (len(text), 0)
        out.append((i, level, title, start, stop, words - after))
        if open_ and open_[-1][0] == level:
            open_.pop()
        open_.append((level, start, words))
    return out[::-1]


def by_text(docs: DataFrame, schema: list[T.StructField], rows: Callable[[str], list[tuple]]) -> DataFrame:
    """``doc_id`` and the rows that ``rows`` gives for each text; null texts have none. Texts are
    taken where they lie, without a shuffle or a join."""
    scratch.bound_batches(docs.sparkSession)
    docs = docs.filter("text IS NOT NULL").select("doc_id", "text")
    whole = T.StructType([docs.schema["doc_id"], *schema])

    def run(batches):
        for batch in batches:
            got = [rows(t) for t in batch.column("text").to_pylist()]
            of = pa.array([i for i, rs in enumerate(got) for _ in rs], pa.int64())
            cells = list(zip(*[r for rs in got for r in rs])) or [()] * len(schema)
            yield pa.record_batch([batch.column("doc_id").take(of), *[pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int32()) for c, f in zip(cells, schema)]], names=whole.names)

    return docs.mapInArrow(run, whole)


def _headed(docs: DataFrame) -> DataFrame:
    return by_text(docs, [T.StructField(n, T.StringType() if n == "title" else T.IntegerType()) for n in ("line_number", "level", "title", "start", "end", "n_words")], headed)


def headings(docs: DataFrame) -> DataFrame:
    """Markdown headings and short numbered lines: level, title, and where the line begins; each
    of several equal lines has its own place."""
    return _headed(docs).select("doc_id", "line_number", "level", "title", F.col("start").alias("position"))


def paragraphs(docs: DataFrame, separator: str = r"\n[ \t\n\r\f]*\n", least: int = 20) -> DataFrame:
    """Parts between blank lines longer than ``least``; a part's start counts two characters for
    each separator before it. Rows that share a doc_id are cut each by itself."""
    between = re.compile(separator)

    def cut(text):
        rows, at = [], 0
        for i, raw in enumerate(between.split(text)):
            part = raw.strip(_BLANK)
            if len(part) > least:
                rows.append((i, part, at, at + len(part), len(part.replace("\x0b", "x").encode().split())))
            at += len(part) + 2
        return rows

    fields = [T.StructField(n, T.StringType() if n == "content" else T.IntegerType()) for n in ("i", "content", "start", "end", "n_words")]
    return by_text(docs, fields, cut).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


def _runs(rows: DataFrame, hit: Column) -> DataFrame:
    """Runs of consecutive lines that ``hit``, numbered within their document."""
    w = Window.partitionBy("doc_id").orderBy("line_number")
    return rows.filter(hit).withColumn("run", F.col("line_number") - F.row_number().over(w))


def list_runs(docs: DataFrame) -> DataFrame:
    """Runs of list lines; the first line says whether bullets or numbers."""
    bullet = F.col("line").rlike(K.BULLET_ITEM)
    rows = _runs(lines(docs), bullet | F.col("line").rlike(K.NUMBER_ITEM) | F.col("line").rlike(K.LETTER_ITEM))
    return rows.groupBy("doc_id", "run").agg(F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.count(F.lit(1)).alias("n_items"), F.min_by(F.when(bullet, "bullet").otherwise("numbered"), "line_number").alias("list_type")).drop("run")


def table_runs(docs: DataFrame) -> DataFrame:
    """Runs of two or more lines with two or more bars; one table a run."""
    bars = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))
    rows = _runs(lines(docs), bars >= 2)
    return rows.groupBy("doc_id", "run").agg(F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows >= 2").drop("run")


def sections(docs: DataFrame) -> DataFrame:
    """From each heading to the next of its level or above: level, title, start, end, words."""
    return _headed(docs.filter("doc_id IS NOT NULL")).select("doc_id", "level", "title", "start", "end", "n_words")


def page_headings(docs: DataFrame) -> DataFrame:
    """Heading lines of page texts with type and level: numbered, all capitals, title case."""
    rows = lines(docs).withColumn("line", X.strip(F.col("line"))).filter(F.length("line").between(1, 100))
    number = F.regexp_extract("line", r"^(\d+(?:\.\d+)*)\.?\s+[A-Z]", 1)
    kind = F.when(number != "", "numbered").when(F.col("line").rlike(r"^[A-Z][A-Z ]{3,}$"), "capitals").when(F.col("line").rlike(r"^[A-Z][a-z]+( [A-Z][a-z]+)*$"), "title")
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    level = F.when(kind == "numbered", F.least(dots + 1, F.lit(3))).when(kind == "capitals", 1).otherwise(2)
    return rows.select("doc_id", "line_number", kind.alias("heading_type"), level.alias("level")).filter("heading_type IS NOT NULL")


def page_sections(pages: DataFrame) -> DataFrame:
    """Sections of paged texts (doc_id, page, text): from a heading line to the next, over page
    breaks. title, first and last page, n_lines, n_words and content (stripped lines that aren't
    blank). A heading without a line below it and lines before the first heading give no section;
    rows without a doc_id or text are left out. One sort by document numbers the sections; only a
    section's own lines meet in one group."""
    rows = pages.filter("doc_id IS NOT NULL").select("doc_id", "page", F.posexplode(F.transform(F.split("text", "\n"), X.strip)).alias("line_number", "line")).filter("line <> ''")
    rows = rows.withColumn("head", X.matches_any(F.col("line"), K.PAGE_SECTION_PATTERNS))
    w = Window.partitionBy("doc_id").orderBy("page", "line_number")
    rows = rows.withColumn("section", F.sum(F.col("head").cast("long")).over(w)).filter("section > 0")
    body = F.when(~F.col("head"), F.struct("page", "line_number", "line"))
    found = rows.groupBy("doc_id", "section").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("title"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count(body).alias("n_lines"),
                                                  F.sum(F.when(~F.col("head"), X.word_count(F.col("line")))).alias("n_words"), F.array_sort(F.collect_list(body)).alias("lines"))
    return found.filter("n_lines > 0").select("doc_id", "section", "title", "page_start", "page_end", "n_lines", "n_words", F.array_join("lines.line", "\n").alias("content"))


def structure_summary(docs: DataFrame) -> DataFrame:
    """One row a document: how many headings, paragraphs, lists, list items, tables and sections it
    has, its deepest heading level, and whether it is hierarchical (two headings or more) and in
    several sections. Documents without any (null and empty texts too) have zeros and a null level;
    rows that share a doc_id are counted together, and rows without one are left out."""
    docs = docs.filter("doc_id IS NOT NULL")
    tagged = lambda rows, kind, n=1, level=None: rows.select("doc_id", F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"), (level if level is not None else F.lit(None)).cast("int").alias("level"))
    parts = [docs.select("doc_id", F.lit("document").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("int").alias("level")),
             tagged(headings(docs), "heading", level=F.col("level")), tagged(paragraphs(docs), "paragraph"), tagged(list_runs(docs), "list", F.col("n_items")), tagged(table_runs(docs), "table"), tagged(sections(docs), "section")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    many = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    out = rows.groupBy("doc_id").agg(many("heading").alias("n_headings"), many("paragraph").alias("n_paragraphs"), many("list").alias("n_lists"), F.sum(F.when(F.col("kind") == "list", F.col("n")).otherwise(0)).alias("n_items"),
                                     many("table").alias("n_tables"), many("section").alias("n_sections"), F.max("level").alias("deepest"))
    return out.withColumns({"hierarchical": F.col("n_headings") >= 2, "several_sections": F.col("n_sections") > 1})


def looks_tabular(text: Column) -> Column:
    """Whether signs of tables are more than a fifth of the lines that aren't blank: bars, tabs,
    runs of blanks, and three or more numbers."""
    full = F.filter(F.split(text, "\n"), lambda s: X.strip(s) != "")
    sign = lambda c: c.cast("int")
    signs = lambda s: sign(F.contains(s, F.lit("|"))) + sign(F.contains(s, F.lit("\t"))) + sign(F.contains(s, F.lit("   "))) + sign(X.count(s, "[0-9]+") >= 3)
    return F.aggregate(full, F.lit(0), lambda a, s: a + signs(s)) > 0.2 * F.size(full)


def clause_sections(docs: DataFrame) -> DataFrame:
    """Lines that head a section, an article or a heading: kind, numbering and level."""
    lines_ = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_number"), X.strip(line).alias("title")))
    full = docs.select("doc_id", F.explode(F.filter(lines_, lambda x: x["title"] != "")).alias("x")).select("doc_id", "x.*")
    t = F.col("title")
    # numbering and kind are made once each: an exploded array keeps the filter from making them again
    facts = X.let(C.numbering(t), lambda n: F.struct(C.structure_kind(t, n).alias("structure_type"), n.alias("number"), C.level_of(t, n).alias("level")))
    kept = F.filter(F.array(facts), lambda x: x["structure_type"].isin("section", "article", "heading"))
    return full.select("doc_id", "line_number", "title", F.explode(kept).alias("x")).select("doc_id", "line_number", "title", "x.*")


def sections_by_title(secs: DataFrame) -> DataFrame:
    """One section for each title of a document: the last one stands."""
    return secs.groupBy("doc_id", "title").agg(F.max_by(F.struct("level", "start", "end", "n_words"), "start").alias("x")).select("doc_id", "title", "x.*")
