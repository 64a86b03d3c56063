"""Merkle-tree fingerprints: sections over paragraphs over pieces of sentences."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

_WORDS = re.compile(r"\s*\S+\s*")
_SENTENCE_END = re.compile(r"[.!?]\S{0,3}\s*\Z")
#: Hex digits shown of a leaf, of a paragraph or section, and of the root; parents hash the whole
#: 128 bits of their children.
_LEAF, _BRANCH, _ROOT = 8, 16, 32


def _digest(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


def leaves(paragraph: str, short: int = 40, fine: int = 3, coarse: int = 12) -> list[str]:
    """The paragraph in pieces that join to it exactly, cut at sentence ends and after ``coarse``
    words (``fine`` in paragraphs of at most ``short`` words, where an edit would else touch every
    piece). An empty paragraph has none, a blank one is its own."""
    words = _WORDS.findall(paragraph) or ([paragraph] if paragraph else [])
    most = fine if len(words) <= short else coarse
    out, held = [], []
    for w in words:
        held.append(w)
        if len(held) >= most or w[-1] in " .!?\t" and _SENTENCE_END.search(w):
            out.append("".join(held))
            held = []
    if held:
        out.append("".join(held))
    return out


def _paragraph(text: str) -> tuple[bytes, str]:
    found = [_digest(b"leaf", x.encode("utf-8", "replace")) for x in leaves(text)]
    d = _digest(b"paragraph", b"".join(found))
    return d, ".".join([d.hex()[:_BRANCH], *[x.hex()[:_LEAF] for x in found]])


def fingerprint(text: str, cache: dict[str, tuple[bytes, str]] | None = None) -> str:
    """``root|section/section...``; a section is ``digest:paragraph,paragraph...``, a paragraph (a
    line) its digest and those of its leaves, joined by dots.

    Every node hashes its children's whole digests, and leaves their exact text, so equal roots
    mean equal texts. A section ends after a blank line, or after a paragraph whose digest says so,
    so that an edit leaves the sections away from it as they are. ``cache`` keeps paragraphs
    between calls on texts that share them.
    """
    cache = {} if cache is None else cache
    sections: list[tuple[bytes, str]] = []
    held: list[tuple[bytes, str]] = []

    def close():
        d = _digest(b"section", b"".join([h[0] for h in held]))
        sections.append((d, f"{d.hex()[:_BRANCH]}:{','.join([h[1] for h in held])}"))
        held.clear()

    for p in text.split("\n"):
        got = cache.get(p)
        if got is None:
            got = cache[p] = _paragraph(p)
        held.append(got)
        if got[0][0] < 64 or not p.strip():
            close()
    if held:
        close()
    root = _digest(b"root", b"".join([d for d, _ in sections]))
    return f"{root.hex()}|{'/'.join([s for _, s in sections])}"


def _sections(mark: str) -> list[str]:
    return mark[_ROOT + 1 :].split("/")


def _paragraphs(section: str) -> list[str]:
    return section[_BRANCH + 1 :].split(",")


def _unlike(x: Counter, y: Counter) -> tuple[Counter, Counter, Counter]:
    """What two multisets share, and what is left of each."""
    same = x & y
    return same, x - same, y - same


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common (Dice, 0 to 1); equal roots give 1.
    Equal sections and paragraphs count whole, and only differing ones are opened."""
    if a[:_ROOT] == b[:_ROOT]:
        return 1.0
    total = a.count(".") + b.count(".")
    if not total:
        return 0.0
    same, x, y = _unlike(Counter(_sections(a)), Counter(_sections(b)))
    common = sum(n * s.count(".") for s, n in same.items())
    same, x, y = _unlike(*[Counter(p for s, n in c.items() for p in _paragraphs(s) * n) for c in (x, y)])
    common += sum(n * p.count(".") for p, n in same.items())
    open_ = [Counter(leaf for p, n in c.items() for leaf in p.split(".")[1:] * n) for c in (x, y)]
    return 2.0 * (common + (open_[0] & open_[1]).total()) / total


def changed_paragraphs(a: str, b: str) -> list[int]:
    """Numbers (from 0) of the lines of ``a`` that ``b`` doesn't have: where ``a`` was edited. Only
    sections that ``b`` lacks are opened."""
    if a[:_ROOT] == b[:_ROOT]:
        return []
    shared = Counter(_sections(a)) & Counter(_sections(b))
    theirs = Counter(p for s, n in (Counter(_sections(b)) - shared).items() for p in _paragraphs(s) * n)
    out, line = [], 0
    for s in _sections(a):
        ps = _paragraphs(s)
        if shared[s]:
            shared[s] -= 1
        else:
            for i, p in enumerate(ps):
                if theirs[p]:
                    theirs[p] -= 1
                else:
                    out.append(line + i)
        line += len(ps)
    return out


OUT = "doc_id long, text string, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string, near_edited double, near_next double, changed array<int>"
_LOW = -(1 << 63)


def _range_bounds(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (did, text hash) of up to ``n`` ranges of about equal size. An id that fills
    several ranges (null ids, say) is cut at even steps of the hash."""
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("did", shares, F.lit(max(100, 4 * n))).alias("q")).first()["q"] if shares else None
    ids, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    d = np.repeat(ids, times)
    step = [_LOW + ((1 << 64) * j // m) for m in times.tolist() for j in range(m)]
    return d, np.array(step, np.int64)


def fingerprint_with_next(docs: DataFrame, tail: int = 4, buckets: int | None = None, with_texts: bool = True) -> DataFrame:
    """Fingerprint each text, an edit of it, and compare with the next document's.

    In the edit the last 1/``tail`` code points (rounded down) give way to the first as many (or
    all) of the next document in ascending doc_id, after the last the first. Columns: ``OUT``
    (``text`` and ``edited`` null if not ``with_texts``; ``changed`` numbers the lines that the edit
    lacks), plus n_chars and edited_sha256.

    Documents are dealt to ranges of doc_id; the first of each range is given to the range
    before it too, so every range is one streaming pass over sorted rows and texts move once.

    Null text is the empty text, whose tree has no leaves; null ids come first; rows that share
    an id follow each other by text (by a hash of it where such rows fill several ranges); an only
    document is its own next; an empty table gives no rows; columns other than doc_id and text
    are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("did", F.coalesce("doc_id", F.lit(_LOW)))
    bound_ids, bound_hashes = _range_bounds(rows, n)
    hot = np.unique(bound_ids[1:][bound_ids[1:] == bound_ids[:-1]])
    rows = rows.withColumn("th", F.xxhash64("text") if len(hot) else F.lit(_LOW))

    def bucket_of(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        ids, hashes = ids.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        out = np.searchsorted(bound_ids, ids, "right").astype(np.int32)
        for h in hot:
            lo, hi = np.searchsorted(bound_ids, [h, h + 1]) if h < (1 << 63) - 1 else (np.searchsorted(bound_ids, h), len(bound_ids))
            at = ids == h
            out[at] = lo + np.searchsorted(bound_hashes[lo:hi], hashes[at], "right")
        return out

    @F.arrow_udf("int")
    def bucket(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(bucket_of(ids, hashes))

    key = F.struct("did", "th")
    firsts = {r["b"]: (r["k"]["did"], r["k"]["th"]) for r in rows.select(bucket("did", "th").alias("b"), key.alias("k")).groupBy("b").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    @F.arrow_udf("array<struct<bucket: int, ahead: boolean>>")
    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        at = bucket_of(ids, hashes).tolist()
        out = [[{"bucket": b, "ahead": False}] + ([{"bucket": before[b], "ahead": True}] if firsts[b] == k else []) for b, k in zip(at, zip(ids.to_pylist(), hashes.to_pylist()))]
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("ahead", pa.bool_())])))

    def run(batches):
        prev, out, size = None, [], 0
        for batch in batches:
            for ahead, doc, text in zip(*(batch.column(c) for c in ("ahead", "doc_id", "text"))):
                ahead, doc, text = ahead.as_py(), doc.as_py(), text.as_py()
                if ahead and prev is None:
                    continue  # a further row with the key of the next range's first
                cache: dict[str, tuple[bytes, str]] = {}
                row = (doc, text, fingerprint(text, cache), cache)
                if prev is not None:
                    out.append(_compare(prev, row, tail, with_texts))
                    size += len(prev[1])
                prev = None if ahead else row
                if size > 1_000_000:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    placed = rows.withColumn("place", F.explode(places("did", "th"))).select("place.bucket", "place.ahead", "did", "th", "doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "did", "th", "text")
            .select("bucket", "ahead", "doc_id", "text").mapInArrow(tidy(run), _SCHEMA))


_SCHEMA = OUT + ", n_chars long, edited_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("text", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("changed", pa.list_(pa.int32())), ("n_chars", pa.int64()), ("edited_sha256", pa.string())])


def _compare(row, following, tail, with_texts):
    doc, text, mark, cache = row
    q = len(text) // tail
    edited = text[: len(text) - q] + following[1][:q]
    edited_mark = fingerprint(edited, cache)
    sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    kept = (text, edited) if with_texts else (None, None)
    return doc, *kept, mark, edited_mark, following[2], likeness(mark, edited_mark), likeness(mark, following[2]), changed_paragraphs(mark, edited_mark), len(text), sha


def _batch(rows):
    cols = zip(*rows) if rows else [[]] * len(_ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
