import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from clausemill.sources import files, sinks

XML = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>Before any heading.</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space="preserve">The first </w:t></w:r><w:r><w:t>part.</w:t></w:r></w:p><w:p/><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>An item</w:t></w:r></w:p></w:body></w:document>"""


def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", XML)
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["References"] = "Fwd: Terms", "x@a.org", "y@b.org, z@b.org", "<1> <2>"
    m.set_content("The plain body of it.")
    m.add_alternative("<p>html</p>", subtype="html")
    m.add_attachment(b"123", maintype="application", subtype="pdf", filename="t.pdf")
    (tmp_path / "b.eml").write_bytes(m.as_bytes())
    (tmp_path / "c.txt").write_text("Some plain text, é.")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "e.docx").write_bytes(b"PK\x03\x04 word/ broken")
    (tmp_path / "f.bin").write_bytes(b"\x00\x01")
    (tmp_path / "g.txt").write_text("short")
    return str(tmp_path)


def test_documents_of_a_folder(spark, tmp_path):
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.text, r.error) for r in files.documents(spark, folder(tmp_path)).collect()}
    assert got["a.docx"] == ("docx", "Before any heading.\nScope\nThe first part.\nAn item", None)
    assert got["b.eml"][0] == "email" and "The plain body of it." in got["b.eml"][1] and got["b.eml"][2] is None
    assert got["c.txt"] == ("text", "Some plain text, é.", None)
    assert got["d.pdf"][2] == "no_pdf_reader" and got["e.docx"][2] == "BadZipFile" and got["f.bin"][2] == "unknown_format" and got["g.txt"][2] == "too_short"


def test_docx_and_mail_details(spark, tmp_path):
    rows = files.read_files(spark, folder(tmp_path))
    ps = files.read_docx(rows.filter("path LIKE '%a.docx'"))
    assert [(r.heading_level, r.is_list) for r in ps.orderBy("pos").collect()] == [(None, False), (1, False), (None, False), (None, True)]
    assert [(r.title, r.content) for r in files.docx_sections(ps).orderBy("section").collect()] == [("Introduction", "Before any heading."), ("Scope", "The first part.\nAn item")]
    m = files.read_mail(rows.filter("path LIKE '%.eml'")).first()
    assert m.recipients == ["y@b.org", "z@b.org"] and m.n_references == 2 and m.is_forward and m.attachments[0].name == "t.pdf" and m.attachments[0].size == 3


def test_declared_formats_and_phishing(spark):
    df = spark.createDataFrame([("Application/PDF; charset=x", "a@b.org", "c@d.org", "URGENT: click here")], "c string, s string, r string, t string")
    r = df.select(files.declared_format(F.col("c")).alias("f"), files.phishing_signs(F.col("s"), F.col("r"), F.col("t")).alias("p")).first()
    assert r.f == "pdf" and r.p == ["sender_mismatch", "urgent", "click here"]


def test_index_round_trip_and_cache(spark, tmp_path):
    v = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [0.0, 1.0], "b")], "vec_id long, embedding array<double>, namespace string")
    sinks.save_index(v, str(tmp_path / "i"))
    assert [(r.vec_id, r.vector_norm) for r in sinks.load_index(spark, str(tmp_path / "i"), "a").collect()] == [(1, 5.0)]
    root = str(tmp_path)
    assert sinks.saved_indexes(spark, root) == ["i"] and sinks.saved_indexes(spark, root + "/none") == []
    with pytest.raises(ValueError):
        sinks.delete_index(spark, root, "../i")
    assert sinks.delete_index(spark, root, "i") and not sinks.delete_index(spark, root, "i") and sinks.saved_indexes(spark, root) == []
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, v int, t string")
    assert sorted(r.t for r in sinks.latest(rows, ["k"], "v").collect()) == ["y", "z"]
    texts = spark.createDataFrame([("p",), ("q",)], "text string")
    cache = texts.filter("text = 'p'").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit(1).alias("hit"))
    hits, misses = sinks.cached(texts, cache)
    assert [r.text for r in hits.collect()] == ["p"] and [r.text for r in misses.collect()] == ["q"]
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_cache_lookup_and_refresh(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    at = lambda t: f"2024-01-01 {t}"
    texts = spark.createDataFrame([("fresh",), ("fresh",), ("old",), ("new",), (" ",), (None,)], "text string")
    rows = [("fresh", 5, at("11:30:00"), 2), ("old", 6, at("11:00:00"), 9), ("unread", 7, at("11:59:00"), 1)]
    cache = spark.createDataFrame(rows, "text string, value int, t string, access_count long").select(sinks.cache_key(F.col("text"), "m").alias("cache_key"), "value", F.col("t").cast("timestamp").alias("created_at"), "access_count", F.col("t").cast("timestamp").alias("last_accessed"))
    got = sinks.looked_up(texts, cache, "m", now)
    assert sorted((r.text or "", r.hit, r.value, r.access_count) for r in got.collect()) == [("", False, None, None), (" ", False, None, None), ("fresh", True, 5, 3), ("fresh", True, 5, 3), ("new", False, None, None), ("old", False, None, None)]
    assert got.filter("text = ' '").first().cache_key is None and got.filter("hit").first().age_seconds == 1800.0
    assert sinks.looked_up(texts, cache, "other", now).filter("hit").count() == 0
    made = got.filter("NOT hit AND cache_key IS NOT NULL").select("cache_key", F.length("text").alias("value"))
    after = {r.value: (r.access_count, str(r.created_at)[11:], str(r.last_accessed)[11:]) for r in sinks.refreshed(cache, got, made, now).collect()}
    assert after == {5: (4, "11:30:00", "12:00:00"), 3: (0, "12:00:00", "12:00:00"), 7: (1, "11:59:00", "11:59:00")} and sinks.refreshed(cache, got, made, now).count() == 4


def stamps(path):
    return {d.name: {f.name: f.stat().st_mtime_ns for f in d.glob("*.parquet")} for d in path.iterdir() if d.is_dir()}


def test_index_upkeep_in_place(spark, tmp_path):
    """Only touched namespaces are rewritten; an emptied one goes; counts are true."""
    path = tmp_path / "i"
    v = spark.createDataFrame([(i, [float(i), 1.0], f"{i % 3}") for i in range(30)], "vec_id long, embedding array<double>, namespace string")
    sinks.save_index(v, str(path))
    before = stamps(path)
    new = spark.createDataFrame([(0, [9.0, 9.0], "0"), (99, [1.0, 2.0], "0"), (1, [5.0, 5.0], "n")], v.schema)
    assert sinks.upsert_index(new, str(path)) == 1
    after = stamps(path)
    assert after["namespace=1"] == before["namespace=1"] and after["namespace=2"] == before["namespace=2"] and after["namespace=0"] != before["namespace=0"] and "namespace=n" in after
    rows = {(str(r.namespace), r.vec_id): r for r in sinks.load_index(spark, str(path)).collect()}
    assert len(rows) == 32 and rows["0", 0].embedding == [9.0, 9.0] and rows["1", 1].embedding == [1.0, 1.0] and rows["n", 1].vector_norm == pytest.approx(50**0.5)
    ids = spark.createDataFrame([(1,), (1,), (4,), (777,)], "vec_id long")
    assert sinks.remove_from_index(spark, str(path), ids) == 3
    last = stamps(path)
    assert "namespace=n" not in last and last["namespace=2"] == before["namespace=2"] and last["namespace=0"] == after["namespace=0"]
    assert sinks.remove_from_index(spark, str(path), ids) == 0
    assert sinks.load_index(spark, str(path)).count() == 29


def test_metadata_of_records(spark):
    df = spark.createDataFrame([(1, "t", [1, 2], None)], "n int, s string, a array<int>, x string").withColumn("at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    m = df.select(sinks.scalar_metadata("n", "s", "a", "x", "at", schema=df.schema).alias("m")).first().m
    assert m == {"n": "1", "s": "t", "a": "[1,2]", "at": "2024-05-06T07:08:09"}
