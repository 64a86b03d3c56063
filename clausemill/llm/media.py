"""Interleaved document sequences: ordered text and media references parsed from HTML, payloads
kept once per digest and resolved by digest joins."""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

#: A name of this operator's own.
_GOT = "_media_got"
ITEM = "struct<pos: int, kind: string, text: string, ref: string, caption: string>"
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "video", "embed": "object"}
_BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "table", "ul", "ol", "blockquote", "pre", "figcaption"}
_SKIPPED = {"script", "style", "template"}


class _Interleaver(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._skip = 0
        self._caption: list[str] | None = None
        self._figure: list[int] | None = None

    def _flush(self):
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self._skip += 1
        if tag in _BLOCKS:
            self._flush()
        if tag == "figure":
            self._figure = []
        elif tag == "figcaption":
            self._caption = []
        elif tag in _MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self._flush()
                if self._figure is not None:
                    self._figure.append(len(self.items))
                self.items.append({"kind": _MEDIA[tag], "text": None, "ref": a["src"], "caption": a.get("alt") or a.get("title")})

    def handle_endtag(self, tag):
        if tag in _SKIPPED and self._skip:
            self._skip -= 1
        if tag == "figcaption" and self._caption is not None:
            caption, self._caption = " ".join("".join(self._caption).split()), None
            for i in self._figure or []:
                self.items[i]["caption"] = caption or self.items[i]["caption"]
        if tag in _BLOCKS:
            self._flush()
        if tag == "figure":
            self._figure = None

    def handle_data(self, data):
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)

    def close(self):
        super().close()
        self._flush()


def interleave(html: str | None) -> list[dict]:
    """The texts and media references of a page in reading order; script and style are left out.
    A figure's caption goes with its media, else their alt or title text does."""
    p = _Interleaver()
    p.feed(html or "")
    p.close()
    return [{"pos": i, **x} for i, x in enumerate(p.items)]


def interleaved(html: Column) -> Column:
    """The sequence of a page, as ``ITEM`` structs."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    @F.arrow_udf(f"array<{ITEM}>")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([interleave(h) for h in pages.to_pylist()], kind)

    return run(html)


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``sequence``, an array of (pos, kind, text, ref, caption). Null or empty
    HTML gives an empty sequence; a column of that name is replaced."""
    return pages.withColumn("sequence", interleaved(pages[html]))


def escaped(text: Column) -> Column:
    """Text as it stands in HTML."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def document_page(text: Column, digest: Column, caption: Column) -> Column:
    """A document as a page: its first line, a figure with the payload that ``digest`` names, then
    its other lines. Null text is empty; nothing is left out."""
    whole = escaped(F.coalesce(text, F.lit("")))
    first = F.substring_index(whole, "\n", 1)
    rest = F.replace(F.substring(whole, F.length(first) + 2, F.length(whole)), F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), escaped(F.coalesce(caption, F.lit(""))), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def without_texts(sequence: Column) -> Column:
    """The items of a sequence with their text's length in its place: what an alignment needs."""
    return F.transform(sequence, lambda x: F.struct(x["pos"].alias("pos"), x["kind"].alias("kind"), F.coalesce(F.length(x["text"]), F.lit(0)).alias("n_chars"), x["ref"].alias("ref"), x["caption"].alias("caption")))


_SIDE = 64


def payload_digest(text: Column) -> Column:
    """sha256 of the payload that ``encode_payloads`` stores for a text."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    zeros = F.when(F.length(data) == 0, _SIDE).otherwise(F.pmod(-F.length(data), F.lit(_SIDE)))
    return F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("00"), zeros))), 256)


def to_png(payload: bytes) -> bytes:
    """8-bit grey PNG, 64 samples a row; ``payload`` is a positive multiple of 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, _SIDE)
    raw = np.zeros((len(rows), _SIDE + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", _SIDE, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made."""
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, _SIDE + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Share of samples in 16 bands of brightness, in thousandths, then mean and deviation."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return ",".join(map(str, [*bands.tolist(), int(x.mean()), int(x.std())]))


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % _SIDE or (_SIDE if not data else 0))


def encode_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, media) of (doc_id, text): the text's padded bytes as PNG.

    ``digest`` is the payload's sha256; ``media`` is null where the task has given that digest
    before (bounded memory of digests), so copies are stored a few times, not each time. Null and
    empty texts are one payload of 64 zero bytes; repeated rows give a row each; an empty table
    gives none; columns other than doc_id and text are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                payload = pad(data)
                d = hashlib.sha256(payload)
                media = None
                if d.digest() not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(d.digest())
                    media = to_png(payload)
                    size += len(media)
                out.append((doc, len(data), d.hexdigest(), media))
                if size > 2_000_000 or len(out) >= 2000:
                    yield _rows(out, _ENCODED)
                    out, size = [], 0
            if out:
                yield _rows(out, _ENCODED)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidy(run), "doc_id long, n_bytes long, digest string, media binary")


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("media", pa.binary())])
_READ = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_payloads(store: DataFrame) -> DataFrame:
    """What the stored media (digest, media) hold, one row a digest: sizes, checks, feature. Rows
    without media are passed over; an empty table gives no rows."""
    def run(batches):
        for batch in batches:
            out = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
                p = from_png(media)
                out.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-_SIDE:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(p)))
            if out:
                yield _rows(out, _READ)

    rows = store.filter(F.col("media").isNotNull()).select("digest", "media")
    found = rows.mapInArrow(tidy(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["digest"])


def digest_of(ref: Column) -> Column:
    """The digest of a ``sha256:`` reference; null for other references."""
    return F.nullif(F.regexp_extract(ref, "^sha256:([0-9a-f]{64})$", 1), F.lit(""))


def resolve(seqs: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """The media items of ``seqs`` (``key``, sequence), a row each, with what ``payloads`` (one
    row a digest) has of them; unresolved ones keep nulls. Only references and the light payload
    rows meet in the join. A null or empty sequence gives no rows; repeated rows give theirs each."""
    items = seqs.select(key, F.explode("sequence").alias("item")).filter(F.col("item.ref").isNotNull()).select(key, "item.pos", "item.kind", "item.ref", "item.caption").withColumn("digest", digest_of(F.col("ref")))
    return items.join(payloads, "digest", "left")


def align(seqs: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """``seqs`` with ``media``: an array as long as ``sequence`` that has, at each media item's
    position, what was resolved for it (null for text and unresolved items). ``key`` names a
    sequence; rows that repeat one get the same array. A null key keeps its sequence and resolves
    nothing; a column called media is replaced."""
    own = [c for c in resolved.columns if c not in (key, "kind", "ref", "caption")]
    got = resolved.filter(F.col("payload_bytes").isNotNull()).groupBy(key).agg(F.collect_set(F.struct(*own)).alias(_GOT))
    found = lambda x: F.try_element_at(F.filter(_GOT, lambda g: g["pos"] == x["pos"]), F.lit(1))
    return seqs.drop("media").join(got, key, "left").withColumn("media", F.transform("sequence", found)).drop(_GOT)
