"""Queries on messages: the documents as multipart mail, the conversations as threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import mail, scratch
from ..sources.tables import dealt, table


def _messages(spark, d):
    """Each document as a message: its text plain and as HTML, in an alternative inside a mixed part,
    with the text attached once more where 3 divides the id; every fifth is a plain message."""
    part = lambda kind, body, more="": F.concat(F.lit(f"--%s\r\nContent-Type: {kind}; charset=utf-8{more}\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(body.cast("binary")), F.lit("\r\n"))
    of = lambda c, b: F.replace(c, F.lit("--%s"), F.lit(f"--{b}"))
    text = F.coalesce("text", F.lit(""))
    html = F.concat(F.lit("<html><p>Shown "), F.col("doc_id").cast("string"), F.lit("</p> &amp; more</html>"))
    head = F.concat(F.lit("From: A <a@x.org>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0200\r\nMessage-ID: <"), F.col("doc_id").cast("string"), F.lit("@x.org>\r\n"))
    plain = F.concat(head, F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(text.cast("binary")))
    inner = F.concat(F.lit("--OUT\r\nContent-Type: multipart/alternative; boundary=IN\r\n\r\n"), of(part("text/plain", text), "IN"), of(part("text/html", html), "IN"), F.lit("--IN--\r\n"))
    extra = F.when(F.col("doc_id") % 3 == 0, of(part("text/plain", text, "\r\nContent-Disposition: attachment; filename=t.txt"), "OUT")).otherwise("")
    whole = F.concat(head, F.lit("MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=OUT\r\n\r\n"), inner, extra, F.lit("--OUT--\r\n"))
    raw = F.when(F.col("doc_id") % 5 == 0, plain).otherwise(whole)
    return dealt(spark, d, "documents", "doc_id").select(F.col("doc_id").cast("string").alias("path"), raw.cast("binary").alias("content"))


def mail_structure(spark, d):
    out = mail.structure(mail.parts(_messages(spark, d), texts=False))
    return out.select(F.col("path").cast("long").alias("doc_id"), "is_multipart", "n_parts", "depth", "has_html", "has_plain_text", "n_attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_bytes"]).alias("attached_bytes"), "n_bytes")


def mail_bodies(spark, d):
    out = mail.bodies(scratch.written(mail.parts(_messages(spark, d)), "mail-parts"))
    return out.select(F.col("path").cast("long").alias("doc_id"), *[F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("plain_text", "html", "combined")])


def mail_headers(spark, d):
    return mail.headers(_messages(spark, d)).select(F.col("path").cast("long").alias("doc_id"), "from_name", "from_address", "message_id", F.date_format("date_sent", "yyyy-MM-dd HH:mm").alias("sent"), "content_type")


def mail_threads(spark, d):
    """Turns as messages: each answers the turn at half its place, every seventh conversation refers to a
    message nobody has; depth and first message of all."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    up = F.when(F.col("turn") > 0, name(F.floor((F.col("turn") - 1) / 2)))
    rows = table(spark, d, "conversations").select(name(F.col("turn")).alias("message_id"), F.when(F.col("conv_id") % 7 == 0, F.lit("nobody")).otherwise(up).alias("in_reply_to"), F.when(F.col("conv_id") % 2 == 0, F.array(name(F.lit(0)))).alias("references"))
    return mail.threads(rows)


QUERIES = {f.__name__: f for f in (mail_structure, mail_bodies, mail_headers, mail_threads)}

_STRIP = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SHOWN = "'Shown ' || doc_id || ' & more'"
SQL = {
    "mail_structure": """SELECT doc_id, doc_id % 5 <> 0 AS is_multipart, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 4 + (doc_id % 3 = 0)::INT END::BIGINT AS n_parts, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS depth, doc_id % 5 <> 0 AS has_html, true AS has_plain_text,
        (doc_id % 5 <> 0 AND doc_id % 3 = 0)::BIGINT AS n_attachments, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN strlen(coalesce(text, '')) ELSE 0 END AS attached_bytes,
        CASE WHEN doc_id % 5 = 0 THEN strlen(coalesce(text, '')) ELSE strlen(coalesce(text, '')) * (1 + (doc_id % 3 = 0)::INT) + strlen('<html><p>Shown ' || doc_id || '</p> &amp; more</html>') END AS n_bytes FROM documents""",
    "mail_bodies": f"""SELECT doc_id, md5({_STRIP}) AS plain_text_md5, md5(CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<html><p>Shown ' || doc_id || '</p> &amp; more</html>' END) AS html_md5, md5(CASE WHEN doc_id % 5 = 0 THEN {_STRIP} ELSE {_SHOWN} END) AS combined_md5 FROM documents""",
    "mail_headers": "SELECT doc_id, 'A' AS from_name, 'a@x.org' AS from_address, doc_id || '@x.org' AS message_id, '2024-01-01 08:00' AS sent, CASE WHEN doc_id % 5 = 0 THEN 'text/plain' ELSE 'multipart/mixed' END AS content_type FROM documents",
    "mail_threads": """WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 7 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 0 END ELSE (turn - 1) // 2 END AS up FROM conversations),
        p AS (SELECT m.conv_id, m.turn, CASE WHEN u.turn IS NOT NULL THEN u.turn WHEN m.conv_id % 2 = 0 AND m.turn > 0 THEN z.turn END AS up FROM m LEFT JOIN m u ON u.conv_id = m.conv_id AND u.turn = m.up LEFT JOIN m z ON z.conv_id = m.conv_id AND z.turn = 0),
        r AS (SELECT conv_id, turn, turn AS top, up, 0 AS depth FROM p UNION ALL SELECT r.conv_id, r.turn, p.turn, p.up, r.depth + 1 FROM r JOIN p ON p.conv_id = r.conv_id AND p.turn = r.up)
        SELECT conv_id || ':' || turn AS message_id, conv_id || ':' || top AS thread_id, depth::BIGINT AS depth FROM r WHERE up IS NULL""",
}
