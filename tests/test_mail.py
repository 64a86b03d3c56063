import datetime as dt
import random
from email.message import EmailMessage

import pytest

from clausemill.sources import mail


def files(spark, messages):
    return spark.createDataFrame([(f"m{i}", bytes(m) if not isinstance(m, bytes) else m) for i, m in enumerate(messages)], "path string, content binary")


def nested():
    """mixed(alternative(plain, related(html, image)), attached html, attached message, plain)"""
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["CC"], m["Date"] = "FW: Plan", "Ann B <ann@a.org>", "x@b.org, y@b.org", "z@c.org", "Tue, 02 Jan 2024 08:30:00 +0100"
    m["Message-ID"], m["In-Reply-To"], m["References"], m["X-Priority"] = "<1@a>", "<0@a>", "<r@a> <0@a>", "2"
    m.set_content("Plain body é\n")
    m.add_alternative("<p>Rich &amp; long</p>", subtype="html")
    m.get_payload()[1].add_related(b"PNG", maintype="image", subtype="png", cid="<i>")
    m.add_attachment("<b>no body</b>", subtype="html", filename="a.html")
    inner = EmailMessage()
    inner["Subject"] = "inside"
    inner.set_content("never a body of the outer one")
    m.add_attachment(inner)
    return m


def plain(text="Only this.\n", subtype="plain"):
    m = EmailMessage()
    m.set_content(text, subtype=subtype)
    return m


def test_parts_are_a_tree(spark):
    rows = mail.parts(files(spark, [nested()])).orderBy("pos").collect()
    assert [(r.part, r.parent, r.content_type) for r in rows] == [("0", None, "multipart/mixed"), ("0.1", "0", "multipart/alternative"), ("0.1.1", "0.1", "text/plain"), ("0.1.2", "0.1", "multipart/related"), ("0.1.2.1", "0.1.2", "text/html"), ("0.1.2.2", "0.1.2", "image/png"), ("0.2", "0", "text/html"), ("0.3", "0", "message/rfc822")]
    assert [r.is_attachment for r in rows] == [False] * 6 + [True, True] and [r.depth for r in rows] == [r.part.count(".") for r in rows]


def test_bodies_and_structure(spark):
    alternative = EmailMessage()
    alternative.set_content("last text\n")
    alternative.add_alternative("<p> </p>", subtype="html")
    rows = mail.parts(files(spark, [nested(), plain(), plain("<p>H</p>", "html"), alternative, b""]))
    got = {r.path: r for r in mail.bodies(rows).collect()}
    assert (got["m0"].plain_text, got["m0"].html, got["m0"].combined) == ("Plain body é", "<p>Rich &amp; long</p>", "Rich & long")
    assert (got["m1"].plain_text, got["m1"].html, got["m1"].combined) == ("Only this.",  "", "Only this.")
    assert (got["m2"].plain_text, got["m2"].combined) == ("", "H")
    assert got["m3"].plain_text == "last text" and tuple(got["m4"])[1:] == ("", "", "")
    s = {r.path: r for r in mail.structure(rows).collect()}
    assert (s["m0"].is_multipart, s["m0"].n_parts, s["m0"].depth, s["m0"].has_html, s["m0"].has_plain_text, s["m0"].n_attachments) == (True, 8, 3, True, True, 2)
    assert [(a.name, a.content_type) for a in s["m0"].attachments] == [("a.html", "text/html"), ("", "message/rfc822")]
    assert not s["m1"].is_multipart and not s["m1"].has_attachments and s["m2"].has_html and not s["m2"].has_plain_text


def test_an_attached_html_alone_is_no_body(spark):
    m = EmailMessage()
    m.set_content("x")
    m.add_attachment("<p>a</p>", subtype="html", filename="f.html")
    r = mail.structure(mail.parts(files(spark, [m]))).first()
    assert not r.has_html and r.has_plain_text and r.n_attachments == 1


def test_headers(spark):
    m = plain()
    m["Date"], m["From"] = "no date at all", "bare@x.org"
    a, b = mail.headers(files(spark, [nested(), m])).orderBy("path").collect()
    assert (a.from_name, a.from_address, a.to_addresses, a.cc_addresses) == ("Ann B", "ann@a.org", ["x@b.org", "y@b.org"], ["z@c.org"])
    assert (a.message_id, a.in_reply_to, a.references, a.priority, a.is_forward) == ("1@a", "0@a", ["r@a", "0@a"], "2", True) and a.date_sent == dt.datetime(2024, 1, 2, 7, 30)
    assert b.date_sent is None and b.from_address == "bare@x.org" and b.references == [] and b.error is None


def test_odd_bytes_keep_their_row(spark):
    odd = [b"\xff\xfe\x00", b"Content-Type: text/plain; charset=nobody-knows\n\nx", b"Content-Type: multipart/mixed; boundary=B\n\nno parts", b"Subject: \xff\n\nbody"]
    rows = mail.parts(files(spark, odd))
    assert {r.path for r in rows.collect()} == {f"m{i}" for i in range(4)} and mail.headers(files(spark, odd)).count() == 4
    assert rows.filter("path = 'm1' AND part = '0'").first().text == "x"


def threads_of(rows):
    """By following parents one by one."""
    ids = {r[0] for r in rows if r[0]}
    up = {}
    for i, reply, refs in rows:
        known = [r for r in [*(refs or []), reply] if r in ids and r != i]
        if i and known:
            up[i] = known[-1]
    out = set()
    for i in ids:
        at, n = i, 0
        while at in up and n <= len(ids):
            at, n = up[at], n + 1
        out.add((i, at, n) if n <= len(ids) else (i, None, None))
    return out


def test_threads(spark):
    rng = random.Random(5)
    chain = [(f"c{i}", f"c{i - 1}" if i else None, None) for i in range(70)]
    rng.shuffle(chain)
    rows = chain + [("a", None, ["gone", "c3"]), ("b", "gone", ["c5", "a"]), ("d", "missing", None), ("self", "self", ["self"]), ("x", "y", None), ("y", "z", None), ("z", "x", None), ("into", "x", None), (None, "a", None), ("", "a", None)]
    df = spark.createDataFrame(rows, "message_id string, in_reply_to string, references array<string>")
    assert {tuple(r) for r in mail.threads(df).collect()} == threads_of(rows)
    assert mail.threads(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_threads(spark, seed):
    rng = random.Random(seed)
    rows = [(f"{i}", rng.choice([None, f"{rng.randrange(60)}"]), rng.choice([None, [f"{rng.randrange(90)}" for _ in range(3)]])) for i in range(60)]
    df = spark.createDataFrame(rows, "message_id string, in_reply_to string, references array<string>")
    assert {tuple(r) for r in mail.threads(df).collect()} == threads_of(rows)
