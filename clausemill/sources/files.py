"""Documents from files: format detection, DOCX and e-mail readers, sections.

Reading is ``binaryFile``; parsing is an Arrow batch function on the executors, and a file that
can't be parsed becomes a row with an ``error``. No PDF reader comes with the environment, so
PDF files are detected and get the error ``no_pdf_reader``.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES = 50 << 20
MIME_FORMATS = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "docx", "message/rfc822": "email", "text/plain": "text"}
HEADERS = ["return-path:", "received:", "from:", "to:", "subject:", "date:", "message-id:"]
PARAGRAPHS = "path string, pos int, style string, heading_level int, is_list boolean, text string, n_words int, error string"
MAILS = "path string, subject string, sender string, recipients array<string>, message_id string, in_reply_to string, n_references int, is_forward boolean, text string, html string, attachments array<struct<name: string, content_type: string, size: long, inline: boolean>>, has_spf boolean, has_dkim boolean, error string"


def read_files(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, content and size of the files that ``pattern`` names and that aren't too large."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= max_bytes).select("path", "content", F.col("length").alias("size_bytes"))


def sniffed_format(content: Column, path: Column) -> Column:
    """Format by first bytes, else by mail headers, else by extension; null if unknown."""
    start = F.substring(content, 1, 1000)
    text = F.lower(F.decode(start, "ISO-8859-1"))
    magic = F.hex(F.substring(content, 1, 4))
    mail = text.rlike("(^|\n)(" + "|".join(HEADERS) + ")")
    name = F.lower(path)
    return (F.when(magic == "25504446", "pdf").when((magic == "504B0304") & F.contains(text, F.lit("word/")), "docx").when(mail, "email")
            .when(F.endswith(name, F.lit(".pdf")), "pdf").when(F.endswith(name, F.lit(".docx")), "docx").when(F.endswith(name, F.lit(".eml")), "email").when(F.endswith(name, F.lit(".txt")), "text"))


def declared_format(content_type: Column) -> Column:
    """Format by MIME type, its parameters left out."""
    kinds = F.create_map(*[F.lit(x) for kv in MIME_FORMATS.items() for x in kv])
    return F.try_element_at(kinds, F.coalesce(F.trim(F.split_part(F.lower(content_type), F.lit(";"), F.lit(1))), F.lit("")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> Iterator[tuple]:
    """(style, heading level, list item, text) of each paragraph that isn't blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for p in body.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if text:
            style = p.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = re.search(r"[Hh]eading\s*(\d+)", name)
            yield name, int(level[1]) if level else None, p.find(f"{_W}pPr/{_W}numPr") is not None or "list" in name.lower(), text


def read_docx(files: DataFrame) -> DataFrame:
    """A row a paragraph of DOCX files; a file that fails gives one row with its error."""
    def run(frames):
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"]):
                try:
                    rows += [(path, i, s, level, item, t, len(t.split()), None) for i, (s, level, item, t) in enumerate(docx_paragraphs(bytes(data)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, 0, None, None, None, None, None, type(e).__name__))
            out = pd.DataFrame(rows, columns=["path", "pos", "style", "heading_level", "is_list", "text", "n_words", "error"])
            yield out.astype({"heading_level": "Int32", "n_words": "Int32"})

    return files.select("path", "content").mapInPandas(run, PARAGRAPHS)


def docx_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections by heading paragraphs; what stands before the first is "Introduction"."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = paragraphs.filter("error IS NULL").withColumn("n", F.sum(F.col("heading_level").isNotNull().cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading_level").isNull(), F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return rows.groupBy("path", "n").agg(F.coalesce(F.max(F.when(F.col("heading_level").isNotNull(), F.col("text"))), F.lit("Introduction")).alias("title"), F.max("heading_level").alias("level"), body.alias("content")).withColumnRenamed("n", "section")


def mail_fields(data: bytes) -> dict:
    m = email.message_from_bytes(data, policy=email.policy.default)
    text, html, attached = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        name, kind = part.get_filename(), part.get_content_type()
        if name or part.get_content_disposition() == "attachment":
            attached.append((name or "", kind, len(part.get_payload(decode=True) or b""), part.get_content_disposition() == "inline"))
        elif kind in ("text/plain", "text/html"):
            (text if kind == "text/plain" else html).append(part.get_content())
    subject = str(m["subject"] or "")
    split = lambda h: [a.strip() for a in str(m[h] or "").split(",") if a.strip()]
    auth = " ".join(str(v).lower() for h in ("received-spf", "authentication-results") for v in m.get_all(h, []))
    return {"subject": subject, "sender": str(m["from"] or ""), "recipients": split("to") + split("cc"), "message_id": str(m["message-id"] or ""), "in_reply_to": str(m["in-reply-to"] or ""), "n_references": len(str(m["references"] or "").split()),
            "is_forward": subject.lower().startswith(("fwd:", "fw:")), "text": "\n".join(text), "html": "\n".join(html), "attachments": attached, "has_spf": "spf" in auth or m["received-spf"] is not None, "has_dkim": m["dkim-signature"] is not None}


def read_mail(files: DataFrame) -> DataFrame:
    """A row a message: headers, bodies, attachments, thread and signature signs."""
    def run(frames):
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"]):
                try:
                    rows.append({"path": path, **mail_fields(bytes(data)), "error": None})
                except (LookupError, ValueError, AssertionError) as e:
                    rows.append({"path": path, "error": type(e).__name__})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?![^<]*>)", MAILS)])

    return files.select("path", "content").mapInPandas(run, MAILS)


URGENT_SUBJECTS = ["urgent", "verify", "suspended", "immediately", "click here", "act now"]


def phishing_signs(sender: Column, reply_to: Column, body: Column) -> Column:
    """Signs: the sender's and the reply address's domains differ; urgent phrases."""
    domain = lambda c: F.regexp_extract(F.lower(c), r"@([a-z0-9.-]+)", 1)
    mismatch = F.when((domain(sender) != "") & (domain(reply_to) != "") & (domain(sender) != domain(reply_to)), "sender_mismatch")
    return F.array_compact(F.array(mismatch, *[F.when(F.contains(F.lower(body), F.lit(w)), w) for w in URGENT_SUBJECTS]))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, error) of a folder's files, each by its own reader. Texts under ten
    characters, unknown formats and failures carry an error."""
    files = read_files(spark, path).withColumn("format", sniffed_format(F.col("content"), F.col("path")))
    docx = read_docx(files.filter("format = 'docx'")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("error").alias("error"))
    mail = read_mail(files.filter("format = 'email'")).select("path", F.concat_ws("\n", F.concat(F.lit("Subject: "), "subject"), F.concat(F.lit("From: "), "sender"), "text").alias("text"), "error")
    plain = files.filter("format = 'text'").select("path", F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("error"))
    other = files.filter("format IS NULL OR format = 'pdf'").select("path", F.lit(None).cast("string").alias("text"), F.when(F.col("format") == "pdf", "no_pdf_reader").otherwise("unknown_format").alias("error"))
    found = docx.unionByName(mail).unionByName(plain).unionByName(other)
    short = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 10, "too_short")
    return files.select("path", "format").join(found, "path").select("path", "format", "text", F.coalesce("error", short).alias("error"))
