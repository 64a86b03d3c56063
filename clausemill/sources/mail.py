"""Messages as trees: MIME parts as rows with their place, bodies folded from them, threads of replies."""

from __future__ import annotations

import datetime as dt
import email
import email.header
import email.headerregistry
import email.parser
import email.policy
import email.utils
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scratch

PARTS = "path string, part string, parent string, depth int, pos int, content_type string, filename string, is_multipart boolean, is_attachment boolean, is_inline boolean, n_bytes long, text string, error string"
HEADERS = "path string, subject string, from_name string, from_address string, to_addresses array<string>, cc_addresses array<string>, bcc_addresses array<string>, reply_to string, date_sent timestamp, message_id string, in_reply_to string, references array<string>, priority string, content_type string, conversation_id string, is_forward boolean, error string"
#: Characters of a message looked through for the end of its headers; longer ones are parsed whole.
_HEAD = 1 << 16
#: Senders, types and the like recur: a value is parsed once.
_HEADER_POLICY = email.policy.default.clone(header_factory=functools.lru_cache(4096)(email.headerregistry.HeaderRegistry()))
_FAULTS = (LookupError, ValueError, AssertionError, TypeError, AttributeError)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def tree(message) -> Iterator[tuple]:
    """(part, parent, depth, position, message part) of a message and all its parts in order. The
    root is 0 and the parts of p are p.1, p.2, …; an attached message is a part, its inside isn't."""
    todo, pos = [("0", None, 0, message)], 0
    while todo:
        part, parent, depth, m = todo.pop()
        yield part, parent, depth, pos, m
        pos += 1
        if m.is_multipart() and m.get_content_maintype() == "multipart":
            todo += [(f"{part}.{i}", part, depth + 1, x) for i, x in reversed(list(enumerate(m.get_payload(), 1)))]


def _leaf(m, texts: bool) -> tuple[int, str | None]:
    """Bytes of a part's content, and its text if it is one and asked for."""
    if m.is_multipart():
        return sum(len(bytes(x)) for x in m.get_payload()) if m.get_content_maintype() == "message" else 0, None
    data = m.get_payload(decode=True) or b""
    if not texts or m.get_content_maintype() != "text":
        return len(data), None
    try:
        return len(data), data.decode(m.get_content_charset("utf-8"), "replace")
    except LookupError:  # a charset that nobody knows
        return len(data), data.decode("utf-8", "replace")


def _part_rows(path: str, data: bytes, texts: bool = True) -> list[tuple]:
    out = []
    # the older policy reads a part's few headers many times faster; names are decoded here
    for part, parent, depth, pos, m in tree(email.message_from_bytes(data, policy=email.policy.compat32)):
        name, way = m.get_filename(), m.get_content_disposition()
        name = name and str(email.header.make_header(email.header.decode_header(name)))
        holder = m.is_multipart() and m.get_content_maintype() == "multipart"
        n, text = _leaf(m, texts)
        out.append((path, part, parent, depth, pos, m.get_content_type(), name, holder, not holder and (name is not None or way == "attachment" or m.get_content_maintype() == "message"), way == "inline", n, text, None))
    return out


def _parsed(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """A message that can't be read gives a row with its error; none is lost. A worker holds a few
    megabytes of messages and of their rows at a time."""
    names = _names(schema)
    scratch.bound_batches(files.sparkSession)

    def run(frames):
        for f in frames:
            rows, size = [], 0
            for path, data in zip(f["path"], f["content"]):
                try:
                    rows += rows_of(path, bytes(data))
                    size += len(data)
                except _FAULTS as e:
                    rows.append((path, *[None] * (len(names) - 2), type(e).__name__))
                if size > 1 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def parts(files: DataFrame, texts: bool = True) -> DataFrame:
    """A row for each MIME part of the messages in ``files`` (path, content), with its text unless
    ``texts`` is False."""
    return _parsed(files, PARTS, functools.partial(_part_rows, texts=texts))


def _when(value) -> dt.datetime | None:
    try:
        return email.utils.parsedate_to_datetime(str(value)).astimezone(dt.timezone.utc).replace(tzinfo=None) if value else None
    except _FAULTS:
        return None


def _header_row(path: str, data: bytes) -> list[tuple]:
    m = email.parser.BytesParser(policy=_HEADER_POLICY).parsebytes(data, headersonly=True)
    get = lambda h: str(m[h] or "")
    split = lambda h: [a.strip() for a in get(h).split(",") if a.strip()]
    name, address = email.utils.parseaddr(get("from"))
    bare = lambda s: s.strip().strip("<>")
    subject = get("subject")
    return [(path, subject, name, address, split("to"), split("cc"), split("bcc"), get("reply-to"), _when(m["date"]), bare(get("message-id")), bare(get("in-reply-to")), [bare(r) for r in get("references").split()],
             get("x-priority") or get("priority"), m.get_content_type(), get("thread-index"), any(s in subject.lower() for s in ("fwd:", "fw:")), None)]


def headers(files: DataFrame) -> DataFrame:
    """A row for each message; a date that can't be read is null, others are UTC. Only what stands
    before the first empty line is handed to Python and parsed."""
    end = F.regexp_instr(F.decode(F.substring("content", 1, _HEAD), "ISO-8859-1"), F.lit(r"(?:\r\n|\r(?!\n)|\n)[\r\n]"))
    return _parsed(files.select("path", F.when(end > 0, F.substring("content", F.lit(1), end + 4)).otherwise(F.col("content")).alias("content")), HEADERS, _header_row)


def structure(rows: DataFrame) -> DataFrame:
    """(path, is_multipart, n_parts, depth, has_html, has_plain_text, has_attachments, n_attachments, attachments,
    n_bytes) of each message. Attached texts are attachments, no bodies."""
    body = lambda kind: F.coalesce(F.max((F.col("content_type") == kind) & ~F.col("is_attachment")), F.lit(False))
    attached = F.when(F.col("is_attachment"), F.struct("pos", F.coalesce("filename", F.lit("")).alias("name"), "content_type", "n_bytes", "is_inline"))
    good = rows.filter("error IS NULL").withColumn("_a", attached)
    return good.groupBy("path").agg(F.max(F.when(F.col("part") == "0", F.col("is_multipart"))).alias("is_multipart"), F.count(F.lit(1)).alias("n_parts"), F.max("depth").alias("depth"), body("text/html").alias("has_html"), body("text/plain").alias("has_plain_text"),
                                    F.count("_a").alias("n_attachments"), F.transform(F.array_sort(F.collect_list("_a")), lambda x: x.dropFields("pos")).alias("attachments"), F.sum(F.when(~F.col("is_multipart"), F.col("n_bytes")).otherwise(0)).alias("n_bytes")).withColumn("has_attachments", F.col("n_attachments") > 0)


def bodies(rows: DataFrame) -> DataFrame:
    """(path, plain_text, html, combined): all plain texts, all HTML, and the text as it is shown.
    Of the branches of a multipart/alternative the last that holds a text is shown, at every level;
    HTML is shown as text. Parts are joined by an empty line, and a message without a text has
    empty ones. Ancestors are found by the parts' paths, so a tree of any depth takes two shuffles."""
    good = rows.filter("error IS NULL")
    texts = good.filter(F.col("content_type").isin("text/plain", "text/html") & ~F.col("is_attachment"))
    steps = F.split("part", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(steps, 1, i), ".").alias("holder"), F.try_element_at(steps, i + 1).cast("int").alias("branch")))
    under = texts.filter("depth > 0").select("path", "part", F.explode(above).alias("a")).select("path", "part", "a.holder", "a.branch")
    choices = under.join(good.filter("content_type = 'multipart/alternative'").select("path", F.col("part").alias("holder")), ["path", "holder"])
    best = F.max("branch").over(Window.partitionBy("path", "holder"))
    hidden = choices.withColumn("best", best).filter("branch <> best").select("path", "part").distinct().withColumn("hidden", F.lit(True))
    shown = F.when(F.col("content_type") == "text/html", T.html_to_text(F.col("text"))).otherwise(F.col("text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "t")))), lambda x: x["t"]), "\n\n")
    marked = texts.join(hidden, ["path", "part"], "left").withColumns({"t": T.strip(F.col("text")), "s": T.strip(shown)})
    seen = F.transform(F.array_sort(F.collect_list(F.when(F.col("hidden").isNull() & (F.col("s") != ""), F.struct("pos", "s")))), lambda x: x["s"])
    out = marked.groupBy("path").agg(joined((F.col("content_type") == "text/plain") & (F.col("t") != "")).alias("plain_text"), joined((F.col("content_type") == "text/html") & (F.col("t") != "")).alias("html"), F.array_join(seen, "\n\n").alias("combined"))
    return good.select("path").distinct().join(out, "path", "left").select("path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("plain_text", "html", "combined")])


def threads(messages: DataFrame) -> DataFrame:
    """(message_id, thread_id, depth): the message a thread begins with and the number of replies from
    there. ``messages`` has message_id, in_reply_to and references; the parent is the message that is
    answered, or else the last reference that there is; without one a message begins a thread.

    Pointers are doubled, so a thread of n replies takes log n joins. Messages whose parents lead round
    in a circle have no thread: theirs is null. Ids that are null or blank are left out, of repeated ones
    the first by order of parent counts.
    """
    ids = messages.filter(F.length("message_id") > 0)
    named = F.concat(F.coalesce("references", F.array().cast("array<string>")), F.array("in_reply_to"))
    offers = ids.select("message_id", F.posexplode(named).alias("rank", "up")).filter("up <> message_id")
    known = offers.join(ids.select(F.col("message_id").alias("up")).distinct(), "up")
    parent = known.groupBy("message_id").agg(F.max(F.struct("rank", "up")).alias("p")).select("message_id", F.col("p.up").alias("up"))
    table = scratch.written(ids.select("message_id").distinct().join(parent, "message_id", "left").select("message_id", F.coalesce("up", "message_id").alias("up"), F.col("up").isNotNull().cast("long").alias("depth")), "threads")
    n, reach = table.count(), 1
    while reach <= n:
        at = table.select(F.col("message_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        after = scratch.written(table.join(at, "up").select("message_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "threads")
        reach, table = reach * 2, after.drop("moved")
        if after.filter("moved").isEmpty():
            return table.select("message_id", F.col("up").alias("thread_id"), "depth")
    stuck = F.col("depth") > n
    return table.select("message_id", F.when(~stuck, F.col("up")).alias("thread_id"), F.when(~stuck, F.col("depth")).alias("depth"))
