"""DOCX as a Spark data source: ``spark.read.format("docx").load(folder)`` after ``register(spark)``.

Files are grouped into partitions by size. Members of a file are read in place and its body is
parsed by pull, an element at a time, so that a large file is never held. A row is a paragraph,
a table, an image or the document's properties (``kind``); the option ``kinds`` names those wanted,
and only the members that these need are opened. It is an option and no pushed filter, since Spark
keeps what a Python source was asked once and would give a reused frame the first filter's rows.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("paragraph", "table", "image", "properties", "error")
SCHEMA = ("path string, kind string, pos int, text string, style string, heading_level int, is_list boolean, has_formatting boolean, n_runs int, fonts array<string>, sizes array<double>, links array<string>, in_table boolean, "
          "n_rows int, n_cells int, target string, place string, properties map<string,string>, error string")
_FIELDS = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMA)]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_PIC = "{http://schemas.openxmlformats.org/drawingml/2006/picture}"
_FAULTS = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, EOFError, NotImplementedError, RuntimeError, ValueError)  # ValueError: a place outside a short file


def _row(path: str, kind: str, pos: int | None, **more) -> tuple:
    values = {"path": path, "kind": kind, "pos": pos, **more}
    return tuple(values.get(f) for f in _FIELDS)


def _relations(z: zipfile.ZipFile, member: str) -> dict[str, str]:
    """Targets of a member's relations by id."""
    folder, name = member.rsplit("/", 1)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    return {e.get("Id", ""): e.get("Target", "") for e in ElementTree.fromstring(z.read(rels))}


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    """Names of styles by id."""
    if "word/styles.xml" not in z.namelist():
        return {}
    out = {}
    with z.open("word/styles.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_W}style":
                name = e.find(f"{_W}name")
                out[e.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "") if name is not None else ""
                e.clear()
    return out


def _on(run, name: str) -> bool:
    e = run.find(f"{_W}rPr/{_W}{name}")
    return e is not None and e.get(f"{_W}val", "1").lower() not in ("0", "false", "none")


def _paragraph(p, styles: dict[str, str], relations: dict[str, str]) -> dict:
    runs = list(p.iter(f"{_W}r"))
    mark = p.find(f"{_W}pPr/{_W}pStyle")
    given = mark.get(f"{_W}val", "") if mark is not None else "Normal"
    style = styles.get(given) or given
    level = re.match(r"[Hh]eading\s*(\d+)", style) or re.match(r"[Hh]eading\s*(\d+)", given)
    fonts = {f.get(f"{_W}ascii") for r in runs for f in r.iter(f"{_W}rFonts")} - {None}
    sizes = {int(s.get(f"{_W}val")) / 2 for r in runs for s in r.iter(f"{_W}sz") if (s.get(f"{_W}val") or "").isdigit()}  # half points
    links = [relations.get(h.get(f"{_R}id", ""), "") or "#" + h.get(f"{_W}anchor", "") for h in p.iter(f"{_W}hyperlink")]
    pieces = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    text = "".join(e.text or "" if e.tag == f"{_W}t" else pieces.get(e.tag, "") for r in runs for e in r)
    return {"text": text.strip(), "style": style, "heading_level": int(level[1]) if level else None, "is_list": p.find(f"{_W}pPr/{_W}numPr") is not None or "list" in style.lower(),
            "has_formatting": any(_on(r, k) for r in runs for k in ("b", "i", "u")), "n_runs": len(runs), "fonts": sorted(fonts), "sizes": sorted(sizes), "links": links}


def _images(e, relations: dict[str, str]) -> list[str]:
    return [relations.get(b.get(f"{_R}embed", ""), b.get(f"{_R}link") or "") for pic in e.iter(f"{_PIC}pic") for b in pic.iter(f"{_A}blip")]


def _members(path: str, z: zipfile.ZipFile, kinds: set[str]) -> Iterator[tuple]:
    """Rows of the body and, for images, of headers and footers. Paragraphs in tables are in_table; a
    nested table is a table of its own."""
    styles = _styles(z) if "paragraph" in kinds else {}
    places = [("word/document.xml", "body")]
    if "image" in kinds:
        places += sorted((n, m[1]) for n in z.namelist() if (m := re.fullmatch(r"word/(header|footer)\d*\.xml", n)))
    n = dict.fromkeys(KINDS, 0)
    for member, place in places:
        relations, open_tables = _relations(z, member), []
        with z.open(member) as f:
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    if e.tag == f"{_W}tbl":
                        open_tables.append([0, 0])
                    continue
                if e.tag == f"{_W}p":
                    if place == "body" and "paragraph" in kinds:
                        found = _paragraph(e, styles, relations)
                        if found["text"]:
                            yield _row(path, "paragraph", n["paragraph"], in_table=bool(open_tables), place=place, **found)
                            n["paragraph"] += 1
                    if "image" in kinds:
                        for target in _images(e, relations):
                            yield _row(path, "image", n["image"], target=target, place=place, in_table=bool(open_tables))
                            n["image"] += 1
                    e.clear()
                elif e.tag in (f"{_W}tr", f"{_W}tc") and open_tables:
                    open_tables[-1][e.tag == f"{_W}tc"] += 1
                    e.clear()
                elif e.tag == f"{_W}tbl":
                    rows, cells = open_tables.pop()
                    if place == "body" and "table" in kinds:
                        yield _row(path, "table", n["table"], n_rows=rows, n_cells=cells, in_table=bool(open_tables), place=place)
                        n["table"] += 1
                    e.clear()


def _properties(path: str, z: zipfile.ZipFile) -> tuple:
    found = {}
    if "docProps/core.xml" in z.namelist():
        for e in ElementTree.fromstring(z.read("docProps/core.xml")):
            found[e.tag.split("}")[-1]] = (e.text or "").strip()
    return _row(path, "properties", 0, properties=found)


def rows_of(path: str, file, kinds: set[str]) -> Iterator[tuple]:
    """All rows of an open file; one that can't be read gives what was read and a row with the error."""
    try:
        with zipfile.ZipFile(file) as z:
            if kinds & {"paragraph", "table", "image"}:
                yield from _members(path, z, kinds)
            if "properties" in kinds:
                yield _properties(path, z)
    except _FAULTS as e:
        if "error" in kinds:
            yield _row(path, "error", None, error="BadZipFile" if isinstance(e, ValueError) else type(e).__name__)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _file_system(path: str):
    """The store of a path or URI and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if re.match(r"file:/[^/]", path) else path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.kinds = {k.strip() for k in options.get("kinds", ",".join(KINDS)).split(",")}
        if not self.kinds <= set(KINDS):
            raise ValueError(f"kinds are {', '.join(KINDS)}")

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        store, root = _file_system(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        groups, held = [], 0
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".docx")), key=lambda f: f.path):
            if not groups or held + f.size > self.bytes:
                groups.append([])
                held = 0
            groups[-1].append(f.path)
            held += f.size
        return [_Files(g) for g in groups]

    def read(self, partition: _Files):
        store, _ = _file_system(self.path)
        for path in partition.paths if partition is not None else []:
            with store.open_input_file(path) as f:
                yield from rows_of(path, f, self.kinds)


class DocxSource(DataSource):
    """Options: path, a folder (all .docx files below it), a file or a URI of a store that Arrow
    opens; kinds, all unless set; partitionBytes, the size of a partition's files, 64 MB unless set."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known."""
    spark.dataSource.register(DocxSource)


def totals(rows: DataFrame) -> DataFrame:
    """(path, n_paragraphs, n_words, n_chars, n_headings, n_lists, n_formatted, n_links, n_tables, n_cells, n_images,
    styles, fonts, error) of each file; paragraphs in tables are counted apart as n_in_table."""
    kind = lambda k: F.col("kind") == k
    body = kind("paragraph") & ~F.col("in_table")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    size = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("path").agg(n(body).alias("n_paragraphs"), size(body, F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("n_words"), size(body, F.length("text")).alias("n_chars"), n(body & F.col("heading_level").isNotNull()).alias("n_headings"), n(body & F.col("is_list")).alias("n_lists"),
                                    n(body & F.col("has_formatting")).alias("n_formatted"), size(kind("paragraph"), F.size("links")).alias("n_links"), n(kind("paragraph") & F.col("in_table")).alias("n_in_table"), n(kind("table")).alias("n_tables"), size(kind("table"), F.col("n_cells")).alias("n_cells"), n(kind("image")).alias("n_images"),
                                    F.array_sort(F.collect_set(F.when(body, F.col("style")))).alias("styles"), flat(F.col("fonts")).alias("fonts"), F.max("error").alias("error"))
