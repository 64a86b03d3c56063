import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausemill.llm import media, merkle, queries

from .odd import TEXTS, documents, empty


def test_roots_likeness_and_edits():
    text = "First paragraph with words. And more words here.\n\nSecond part of it.\nThird line, which is different from others.\n" + "\n".join(f"Line number {i} says something else." for i in range(40))
    edit = text.replace("number 20 says", "number 20 sings")
    a, b, c = map(merkle.fingerprint, (text, edit, "Nothing of the sort."))
    assert merkle.fingerprint(text) == a and a.split("|")[0] != b.split("|")[0]
    assert merkle.likeness(a, a) == 1 and 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, c) == 0
    assert merkle.likeness(a, b) == merkle.likeness(b, a)
    assert merkle.changed_paragraphs(a, b) == [24] == merkle.changed_paragraphs(b, a) and merkle.changed_paragraphs(a, a) == []
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1 and merkle.likeness(merkle.fingerprint(""), a) == 0
    assert merkle.fingerprint("a b\n") != merkle.fingerprint("a b")


def pieces(text):
    """The leaves of a text by the rule in words, apart from the module: exact pieces of lines, cut
    at sentence ends and after 3 words (12 in lines of more than 40)."""
    out = []
    for line in text.split("\n"):
        words = re.findall(r"\s*\S+\s*", line) or [line] * bool(line)
        held = ""
        n = 0
        for w in words:
            held, n = held + w, n + 1
            if n == (3 if len(words) <= 40 else 12) or re.search(r"[.!?]\S{0,3}\s*\Z", w) and w[-1] in " .!?\t":
                out.append(held)
                held, n = "", 0
        out += [held] * bool(held)
    return Counter(out)


def dice(a, b):
    if a == b:
        return 1.0
    x, y = pieces(a), pieces(b)
    return 2 * (x & y).total() / (x.total() + y.total()) if x or y else 0.0


def lacking(a, b):
    """Lines of ``a`` that ``b`` lacks, as a count: which of several equal ones is open."""
    return (Counter(a.split("\n")) - Counter(b.split("\n"))).total()


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(dice(t, edited), 9), round(dice(t, following), 9), lacking(t, edited)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "changed"]


def shown(rows):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), len(r.changed)) for r in rows), key=str)


def test_leaves_join_to_the_text_and_roots_tell_texts_apart():
    rng = random.Random(3)
    texts = {"".join(rng.choice(["a", "bc ", ". ", "\n", "\t", " ", "é!", "\u2003"]) for _ in range(rng.randint(0, 60))) for _ in range(2000)}
    assert all("".join(merkle.leaves(line)) == line for t in texts for line in t.split("\n"))
    marks = {t: merkle.fingerprint(t) for t in texts}
    assert len({m.split("|")[0] for m in marks.values()}) == len(texts)
    for a, b in zip(list(texts), list(texts)[1:]):
        assert merkle.likeness(marks[a], marks[b]) == pytest.approx(dice(a, b))
        assert len(merkle.changed_paragraphs(marks[a], marks[b])) == lacking(a, b)


def test_ids_that_fill_several_ranges(spark):
    rows = [(7, f"text number {i} of many with one id") for i in range(300)] + [(None, f"no id {i}") for i in range(200)] + [(i, f"other {i}") for i in range(1000, 1020)]
    got = merkle.fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), buckets=12).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got) == sorted((i is not None, i or 0, t) for i, t in rows)
    assert len({r.next_fingerprint for r in got}) == len(rows) and {r.next_fingerprint for r in got} == {r.fingerprint for r in got}


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_documents_across_ranges(spark, buckets):
    got = merkle.fingerprint_with_next(documents(spark).repartition(3), buckets=buckets).select(*COLUMNS).collect()
    assert shown(got) == expected([t[:2] for t in TEXTS])


def test_fingerprint_query(spark, sf):
    got = queries.op7_merkle_fingerprint(spark, sf).select(*COLUMNS).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert shown(got) == expected(docs)
    assert sum(r.near_edited for r in got) / len(got) > 0.6 > 0.05 > sum(r.near_next for r in got) / len(got)


def test_fingerprints_of_few_documents(spark):
    one = documents(spark).filter("doc_id = 1")
    r = merkle.fingerprint_with_next(one).first()
    assert r.near_next == 1 and r.next_fingerprint == r.fingerprint
    assert merkle.fingerprint_with_next(empty(spark)).count() == 0


HTML = """<html><head><style>p {}</style><script>var x = '<img src=no>';</script></head><body><h1>Title &amp; more</h1><p>Before <b>the</b> picture.</p>
<figure><img src="sha256:{d}" alt="alt words"><figcaption>The <i>caption</i></figcaption></figure><p>After.</p><img src="http://x/y.png" title="t"><img alt="no source"><video src="v.mp4"></video> tail</body>"""


def test_interleaving_keeps_order_and_captions():
    got = [(x["pos"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.interleave(HTML.replace("{d}", "00"))]
    assert got == [(0, "text", "Title & more", None), (1, "text", "Before the picture.", None), (2, "image", "sha256:00", "The caption"), (3, "text", "After.", None), (4, "image", "http://x/y.png", "t"), (5, "video", "v.mp4", None), (6, "text", "tail", None)]
    assert media.interleave(None) == media.interleave("") == []
    assert media.interleave("<p>open <img src=a")[0]["text"].split()[0] == "open"


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, bytes(range(256)) * 5 + b"z"])
def test_png_round_trip(data):
    p = media.pad(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p[: len(data)] == data and not p[len(data) :].strip(b"\0")
    m = media.to_png(p)
    assert media.from_png(m) == p and m.startswith(b"\x89PNG")


def test_digest_join_aligns(spark):
    stored = media.encode_payloads(documents(spark)).cache()
    digest = stored.filter("doc_id = 1").first().digest
    pages = spark.createDataFrame([(1, HTML.replace("{d}", digest)), (2, HTML.replace("{d}", "f" * 64)), (3, None)], "page_id long, html string")
    seqs = media.sequences(pages)
    got = media.resolve(seqs, media.read_payloads(stored), "page_id")
    assert {(r.page_id, r.pos, r.caption): r.payload_bytes for r in got.collect() if r.digest} == {(1, 2, "The caption"): 64, (2, 2, "The caption"): None}
    rows = {r.page_id: r for r in media.align(seqs, got, "page_id").collect()}
    assert [m and (m.digest, m.payload_bytes) for m in rows[1].media] == [None, None, (digest, 64), None, None, None, None] and rows[3].media == []
    assert rows[2].media == [None] * 7


def test_media_query(spark, tmp_path):
    documents(spark).select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op10_media_sequences(spark, str(tmp_path))
    got = rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "sequence_chars").collect()
    want = []
    for i, t, _, _ in TEXTS:
        d = (t or "").encode()
        p = media.pad(d)
        m = media.to_png(p)
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        full = [x for x in lines if x]
        want.append((i, len(d), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature_of(p), int(bool(lines[0])), f"document {i}" if i is not None else None, len(full) + 1, sum(map(len, full))))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    empty(spark).select("doc_id", "text").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op10_media_sequences(spark, str(tmp_path / "none")).count() == 0


def test_pages_parse(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = media.sequences(pages).select("page_id", F.size("sequence").alias("n")).collect()
    assert len(got) == pages.count() and all(r.n > 0 for r in got)
