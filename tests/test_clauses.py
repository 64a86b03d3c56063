"""Clauses are cut and matched in Arrow batches, as the SQL of another engine has them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from clausemill import plans
from clausemill.functions import clauses as X
from clausemill.functions import constants as K
from clausemill.operators import clauses as C
from clausemill.plans import clauses as P

LONG = "The party shall pay the fee for any breach of this agreement. "
TEXTS = [
    LONG + "\n\n \t" + LONG * 2 + "\x0b\n\nshort\n\n\n" + LONG, "", "\n\n\n\n", None, " \n\n" + "x" * 51, LONG * 33, (LONG * 33)[:2000], (LONG * 33)[:2001], (LONG * 40)[:1999],
    "éparty and İf the contract’s fee, which Éshall be paid, where WARé or war or a pandemic is near", '"Fee" means x. "Fee" means y. Definition: the purpose, for the purposes of this agreement it shall',
    '  "Fee"  mean the sum of $1,000,,$5 or 10 USD, 10usd, 7 dollars5 of payment and invoice by a party', "governing\x0blaw and governing \n law, applicable\tlaw, of a contract; the courts of it\rfee", "Keep shall and parıty \U0001f600 party liable " * 3,
    "Shall and shall-mean and shall  mean: non-compliance, breach_es, breach; the party agrees to, agree  to", LONG[:49], LONG[:50], LONG[:51], " " + LONG[:50] + " \n\n ", "\U0001f600" * 20 + " party shall " + "\U0001f600" * 20,
]


@pytest.fixture(scope="module")
def odd():
    con = duckdb.connect()
    con.execute("CREATE TABLE odd (clause_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?)", list(enumerate(TEXTS)))
    return con


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "clause_id bigint, text string")


def test_odd_clauses(spark, odd):
    want = odd.sql(f"SELECT clause_id, start::BIGINT, md5(text), {P._TYPE} FROM ({P._BEST} ({P._SEGMENTS.replace(P._PARTED, 'SELECT * FROM odd')})) WHERE length(text) > 50 AND {P._likely('text')}").fetchall()
    got = C.clauses(docs(spark)).select("clause_id", "start", F.md5("part"), "clause_type").collect()
    assert len(want) > 10 and sorted(map(tuple, got)) == sorted(want)


def test_odd_types(spark, odd):
    want = odd.sql(f"SELECT clause_id, {P._TYPE}, round({P._CONF}, 6), {P._likely('text')} FROM ({P._BEST} odd) WHERE text IS NOT NULL").fetchall()
    rows = docs(spark).select("clause_id", X.type_and_confidence(F.col("text")).alias("x"), X.likely_clause(F.col("text")).alias("likely"))
    got = {r[0]: tuple(r) for r in rows.select("clause_id", "x.clause_type", F.round("x.confidence", 6), "likely").collect()}
    assert got.pop(TEXTS.index(None))[1:] == ("other", 0.5, None)
    assert sorted(got.values()) == sorted(want)


def test_parts_meet_in_batches(spark):
    many = spark.createDataFrame([(i, "\n\n".join([LONG] * (i % 5) + ["tiny"] + [LONG])) for i in range(25_000)], "clause_id bigint, text string").coalesce(1)
    n = len(LONG) + 1  # stripped, and two for the separator
    got = C.clauses(many).groupBy((F.col("clause_id") % 5).alias("k")).agg(F.count("start"), F.sum("start")).collect()
    assert sorted(map(tuple, got)) == [(k, 5000 * (k + 1), 5000 * (n * k * (k - 1) // 2 + k * n + 6)) for k in range(5)]


def test_patterns_run_in_batches(spark, sf):
    plan = plans.queries()["clauses"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(w in plan for w in ("Window", "Sort", "Join", K.LIKELY_CLAUSE[0], K.CLAUSE_INDICATORS["right"][0]))
    for name in ("clause_type", "clauses_from_chunks", "clause_llm_merge", "clauses_by_type"):
        assert K.CLAUSE_INDICATORS["right"][0] not in plans.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_records_meet_in_no_join(spark, sf, odd):
    plan = plans.queries()["clause_records"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(w in plan for w in ("Window", "Sort", "Join", K.KEY_TERMS[0]))
    cut = "md5(substr(d.text, CAST(greatest(start - 60, 0) AS BIGINT) + 1, CAST(start + length(s.text) + 60 - greatest(start - 60, 0) AS BIGINT)))"
    want = odd.sql(f"SELECT clause_id, start::BIGINT, {cut} FROM ({P._SEGMENTS.replace(P._PARTED, 'SELECT * FROM odd')}) s JOIN odd d USING (clause_id) WHERE length(s.text) > 50 AND {P._likely('s.text')}").fetchall()
    got = C.clauses(docs(spark), types=False, around=60).select("clause_id", "start", F.md5("context")).collect()
    assert len({w[2] for w in want}) > 10 and sorted(map(tuple, got)) == sorted(want)


def test_tried_only_where_they_may_match(spark):
    starts = ["1.2 a", "\x0b 12.\tb", "(a) c", "[9] d", "( a) e", "iv. f", "IV g", "x. h", "X. i", "b", "b ", "i", "٣ j", "mix k", "Mix. l", "civil", "1", "a.\nm", "vi\n\nn o\n", "[B] p", ".1 q", None, ""]
    words = ["see SECTION 1.2 and subsection (b), Schedule C, hereunder", "ſection 4, Kelvin above", "subparagraph (9) BELOW", "whereof herein", "exhibit A1; Appendix 7", "Clause x", "paragraph 1.", "Governing  law, governing law; acts of god, act\nof god",
             "non-compliance non compliance partyparties party, parties' Parties CONFIDENTIAL", "dispute resolution and dispute; notice_ notification İnotice", "Warranty warranties representation guarantee transfer expiration renewal juRisdiction", *TEXTS]
    rows = spark.createDataFrame([(t,) for t in starts + words], "t string")
    t, text = F.col("t"), X.strip(F.col("t"))
    each = F.concat(*[F.regexp_extract_all(F.lower(t), F.lit(p), F.lit(0)) for p in K.KEY_TERMS], F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(t, F.lit(r"\b[A-Z][A-Z\s]{2,}\b"), F.lit(0)))
    pairs = {"number": (X.numbering(t), X.first_of(text, K.NUMBERINGS)), "rest": (X.numbered_rest(t), F.trim(X.first_of(text, K.NUMBERINGS, 2))), "terms": (X.key_terms(t), F.array_sort(F.array_distinct(each))),
             "refs": (X.references(t), F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(g)) for p, g in K.REFERENCES]))))}
    for name, (a, b) in pairs.items():
        got = rows.select("t", a.alias("a"), b.alias("b")).collect()
        assert [(r.t, r.a) for r in got] == [(r.t, r.b) for r in got] and sum(bool(r.a) for r in got) > 5, name
