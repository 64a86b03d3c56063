import hashlib
import re

import pytest

from clausemill.llm import pii, queries

from .odd import TEXTS, documents, empty

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


ODD = ["a@b.c_d@e.f", "a@b.c..d@e.f", "x@y", "x@y.z.", "..@a.b.c-d..e@f.g", "1.2.3.4.5", "999.1.1.1 1.2.3.400", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111-", "41111111 11111111 ", "1--4111111111111111", "-4111111111111111-5",
       "+1 (325) 555-8094", "+1((((", "+12345678 9+1 234 567 890", "é€a@b.cd 4111111111111111 \U0001f600 +49 (0) 89 1234567", "a@b@c.d", "4" * 5000, "a." * 3000 + "@b" + ".c" * 4000, None, "", "@", "+", "%a@b.c%d@e-.f", "1 2 3 4 5 6 7 8 9 0 1 2 8", "a" * 50000 + "@", "12 " * 9000]


def test_base_spans_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r.base for r in pii.find_personal_data(docs).collect()}
    assert got == {i: ",".join(plain(t)) for i, t in enumerate(ODD)}


def test_query_against_plain_patterns(spark, sf):
    got = {r.doc_id: r for r in queries.op3_contextual_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r, want = got[d.doc_id], plain(d.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | ({""} if not r.spans else set())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"Please call me on +1 (325) 555-{8000 + i} soon, thanks {i}.") for i in range(12)]
    rows += [(100, "Please call me on 0325-555-9999 soon, thanks."), (101, "The total was 12345678 units."), (102, "Elsewhere 0325-555-9999 again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base, r.spans) for r in pii.find_personal_data(docs).collect()}
    at = rows[12][1].index("0325")
    assert got[100] == ("", f"phone:{at}:{at + 13}")
    assert got[102][1] == "phone:10:23" and got[101] == ("", "")
    assert all(got[i][0] == got[i][1] != "" for i in range(12))


def test_identifiers_written_in_groups(spark):
    rows = [(i, f"Please call me on +1 (325) 555-{8000 + i} soon, thanks {i}.") for i in range(12)]
    for i, v in enumerate(["(325) 555-8094", "020 7946 0958", "0325 555 9999"]):
        rows.append((100 + i, f"Please call me on {v} soon, thanks."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    for i, v in enumerate(["(325) 555-8094", "020 7946 0958", "0325 555 9999"]):
        assert got[100 + i] == f"phone:18:{18 + len(v)}"


def test_bootstrap_runs_until_it_settles(spark):
    marks = lambda step: [f"p{step}_{k}" for k in range(6)]
    edges = [("phone", f"s{j}", marks(0)) for j in range(40)]
    for step in range(6):  # the values of each step prove the patterns of the next
        edges += [(None, f"v{step}_{j}", marks(step) + marks(step + 1)) for j in range(8)]
    seen = spark.createDataFrame(edges, "kind string, value string, contexts array<string>")
    got = {r.value for r in pii.bootstrap(seen, min_pattern=0.4, min_value=0.4).collect()}
    assert got == {f"v{step}_{j}" for step in range(6) for j in range(8)}


def test_patterns_that_mix_discover_nothing(spark):
    rows = [(i, f"code is +1 (325) 555-{8000 + i} x") for i in range(5)] + [(50 + i, f"code is {77000 + i} x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.base == r.spans for r in pii.find_personal_data(docs).collect())


def test_shapes_find_what_the_base_patterns_lose(spark):
    check = lambda d: next(c for c in "0123456789" if luhn(d + c))
    cards = [d + check(d) for d in (f"4929348{i}8514{i}" for i in range(10, 30))]
    rows = [(i, f"{chr(97 + i)}w {chr(97 + i)}x {c} {chr(97 + i)}y z") for i, c in enumerate(cards)]
    rows = [(100 + i, t) for i, t in rows] + [(10, f"a b {cards[0][:-1]}{(int(cards[0][-1]) + 1) % 10} c"), (11, "c d 4242424242424242 5105105105105100 e"), (12, "g h 4222.2222.2222.2220 k"), (13, "m n 9111111111111111 4242424242424241 o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base, r.spans) for r in pii.find_personal_data(docs).collect()}
    assert got[10] == ("", "") and got[13] == ("", "")  # refused by the check digit
    assert got[11] == ("", "card:4:20,card:21:37")
    assert got[12][1] == "card:4:23"


def test_hidden_values_come_back(spark):
    rows = [(i, f"Send it to +1 (325) 555-{4000 + 7 * i} by noon {i}.") for i in range(60)] + [(100 + i, f"From host 10.0.{i}.7 today {i}") for i in range(60)]
    got = {r.kind: r for r in pii.held_back(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {"phone", "ip"} and all(r.n_hidden > 3 and r.n_right == r.n_found >= 0.9 * r.n_hidden for r in got.values())


def test_odd_documents(spark):
    got = pii.find_personal_data(documents(spark)).collect()
    assert len(got) == len(TEXTS) and all(r.base == "" for r in got)
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    for frame in (pii.find_base(docs), pii.find_personal_data(docs)):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())


@pytest.mark.parametrize("value,ok", [("4111111111111111", True), ("4111111111111112", False), ("411111111111", False)])
def test_luhn(spark, value, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii._luhn(F.lit(value)).alias("x")).first().x is ok
