import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from clausemill.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
PIC = '<w:r><w:drawing><pic:pic><pic:blipFill><a:blip r:embed="{}"/></pic:blipFill></pic:pic></w:drawing></w:r>'
BODY = f"""<w:document {NS}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/><w:rFonts w:ascii="Arial"/><w:sz w:val="21"/></w:rPr><w:t xml:space="preserve">Bold </w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:rFonts w:ascii="Times"/></w:rPr><w:tab/><w:t>text é</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr/></w:pPr><w:hyperlink r:id="rId1"><w:r><w:t>a link</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="top"><w:r><w:t> and up</w:t></w:r></w:hyperlink></w:p>
<w:p/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p>{PIC.format('rId2')}<w:r><w:t>deep</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:p>{PIC.format('rId2')}{PIC.format('rId3')}</w:p></w:body></w:document>"""
RELS = '<Relationships xmlns="x"><Relationship Id="rId1" Target="http://x.org/y"/><Relationship Id="rId2" Target="media/one.png"/><Relationship Id="rId3" Target="media/two.png"/></Relationships>'
STYLES = f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
HEADER = f'<w:hdr {NS}><w:p>{PIC.format("rId9")}</w:p></w:hdr>'
CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>The title</dc:title><cp:revision>3</cp:revision></cp:coreProperties>'


def written(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in {"word/document.xml": BODY, "word/_rels/document.xml.rels": RELS, "word/styles.xml": STYLES, "word/header1.xml": HEADER, "docProps/core.xml": CORE, **members}.items():
            if data is not None:
                z.writestr(name, data)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docx.register(spark)
    root = tmp_path_factory.mktemp("docs")
    (root / "in").mkdir()
    written(root / "a.docx")
    written(root / "in" / "B.DOCX", **{"word/styles.xml": None, "word/header1.xml": None, "docProps/core.xml": None, "word/_rels/document.xml.rels": None})
    (root / "broken.docx").write_bytes(b"PK\x03\x04 nothing")
    written(root / "cut.docx", **{"word/document.xml": BODY[:900]})
    (root / "other.txt").write_text("x")
    return str(root)


def test_paragraphs(spark, folder):
    rows = spark.read.format("docx").load(folder).filter("path LIKE '%/a.docx' AND kind = 'paragraph'").orderBy("pos").collect()
    assert [(r.text, r.in_table) for r in rows] == [("Scope", False), ("Bold \ttext é", False), ("a link and up", False), ("c1", True), ("deep", True)]
    assert (rows[0].style, rows[0].heading_level) == ("heading 1", 1)
    assert (rows[1].has_formatting, rows[1].n_runs, rows[1].fonts, rows[1].sizes, rows[1].style) == (True, 2, ["Arial", "Times"], [10.5], "Normal")
    assert rows[2].is_list and rows[2].links == ["http://x.org/y", "#top"] and not rows[2].has_formatting


def test_totals(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in docx.totals(spark.read.format("docx").load(folder)).collect()}
    a, b = got["a.docx"], got["B.DOCX"]
    assert (a.n_paragraphs, a.n_words, a.n_chars, a.n_headings, a.n_lists, a.n_formatted, a.n_links, a.n_in_table, a.n_tables, a.n_cells, a.n_images) == (3, 8, 30, 1, 1, 1, 2, 2, 2, 4, 4)
    assert a.styles == ["Normal", "heading 1"] and a.fonts == ["Arial", "Times"] and a.error is None
    assert (b.n_paragraphs, b.n_headings, b.n_images, b.styles) == (3, 0, 3, ["H1", "Normal"])
    assert got["broken.docx"].error == "BadZipFile" and got["cut.docx"].error == "ParseError" and "other.txt" not in got


def test_tables_images_and_properties(spark, folder):
    df = spark.read.format("docx").load(folder).filter("path LIKE '%/a.docx'")
    assert [(r.n_rows, r.n_cells, r.in_table) for r in df.filter("kind = 'table'").orderBy("pos").collect()] == [(1, 1, True), (2, 3, False)]
    assert sorted((r.target, r.place) for r in df.filter("kind = 'image'").collect()) == [("", "header"), ("media/one.png", "body"), ("media/one.png", "body"), ("media/two.png", "body")]
    assert df.filter("kind = 'properties'").first().properties == {"title": "The title", "revision": "3"}


def test_only_wanted_kinds_are_read(spark, folder):
    some = spark.read.format("docx").option("kinds", "table, properties").load(folder)
    assert {r.kind for r in some.collect()} == {"table", "properties"} and some.filter("path LIKE '%/a.docx'").count() == 3
    opened = []

    class Watched(zipfile.ZipFile):
        def open(self, name, *a, **k):
            opened.append(getattr(name, "filename", name))
            return super().open(name, *a, **k)

    with Watched(f"{folder}/a.docx") as z:
        assert docx._properties("x", z)[1] == "properties" and opened == ["docProps/core.xml"]
    df = spark.read.format("docx").load(folder)
    assert df.filter("kind = 'table' AND path LIKE '%/a.docx'").count() == 2 and df.select("path").distinct().count() == 4
    with pytest.raises(Exception, match="kinds are"):
        spark.read.format("docx").option("kinds", "x").load(folder).count()


def test_files_are_grouped_by_size(spark, folder):
    assert len(docx._Reader({"path": folder}).partitions()) == 1
    assert len(docx._Reader({"path": folder, "partitionbytes": "1"}).partitions()) == 4
    assert spark.read.format("docx").option("partitionBytes", 1).load(f"file://{folder}").rdd.getNumPartitions() == 4
    with pytest.raises(FileNotFoundError):
        docx._Reader({"path": f"{folder}/none"}).partitions()


def test_a_large_file_is_not_held():
    one = "<w:p><w:r><w:t>" + "word " * 200 + "</w:t></w:r></w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("word/document.xml", "w", force_zip64=True) as f:
            f.write(f"<w:document {NS}><w:body>".encode())
            for _ in range(20_000):
                f.write(one.encode())
            f.write(b"</w:body></w:document>")
    tracemalloc.start()
    n = sum(1 for _ in docx.rows_of("x", data, {"paragraph"}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 12 << 20  # the body is 21 MB
