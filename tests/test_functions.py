"""Exact cases of the functions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clausemill.functions import claims, clauses, text
from clausemill.operators import chunking, search, state, structure


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string").select(*columns)
    r = df.first()
    return r[0] if len(columns) == 1 else tuple(r)


T = lambda: F.col("t")


@pytest.mark.parametrize("q,want", [
    ("46-year-old male, knee surgery in Pune, 3-month-old insurance policy", {"age": 46, "gender": "male", "procedure": "knee surgery", "location": "Pune", "policy_age_months": 3}),
    ("surgery in Mumbai", {"age": None, "procedure": "knee surgery", "location": "Mumbai"}),
    ("Patient claims Rs 50,000 for accident treatment in Delhi", {"amount_claimed": 50000.0, "procedure": "accident", "location": "Delhi"}),
    ("Surgery performed on 12/06/2025 in Chennai", {"claim_date": "12/06/2025", "location": "Chennai"}),
    ("a female at Apollo hospital, 2 year policy", {"gender": "female", "hospital": "Apollo", "policy_duration_months": 24}),
])
def test_questions(spark, q, want):
    got = spark.createDataFrame([(q,)], "t string").select(*[c.alias(k) for k, c in claims.parse(T()).items()]).first().asDict()
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize("s,number", [("1.1 Terms", "1.1"), ("i. Scope", "i."), ("(a) Part", "a"), ("[2] Note", "2"), ("Terms", None)])
def test_numbering(spark, s, number):
    assert one(spark, s, clauses.numbering(T())) == number


@pytest.mark.parametrize("s,kind", [('"Fee" means the sum defined as such', "definition"), ("The party shall deliver and must report", "obligation"), ("The invoice states payment of the fee", "payment"), ("Upon breach or default", "termination"), ("Plain words", "other")])
def test_clause_types(spark, s, kind):
    assert one(spark, s, clauses.type_and_confidence(T())["clause_type"]) == kind


def test_references_and_terms(spark):
    s = 'See Section 1.2, Clause 3 and Schedule A; "Loss" and the party in BREACH NOW.'
    assert one(spark, s, clauses.references(T())) == ["1.2", "3", "A"]
    assert {"Loss", "party", "breach"} <= set(one(spark, s, clauses.key_terms(T())))


def test_normalisation(spark):
    s = "a b c\r\nd\re  f “q” ‘s’ —​\x00­"
    assert one(spark, s, text.normalise(T())) == "a b c\nd\ne f \"q\" 's' -"
    assert one(spark, "é", text.nfc(T())) == "é"
    assert one(spark, "won't can't isn't we'll", text.expand_contractions(T())) == "will not cannot is not we will"
    assert one(spark, "BIG NEWS\nSmall\nROOM 12", text.title_case_lines(T())) == "Big News\nSmall\nROOM 12"


def test_patterns_and_readability(spark):
    got = one(spark, "Mail a.b@c.com or call 555-123-4567, see https://x.org/y", *[text.pattern_counts(T())[k] for k in ("emails", "phones", "urls")])
    assert got == (1, 1, 1)
    assert [one(spark, w, text.syllable_total(T())) for w in ("cake", "the", "banana", "rhythm", "x")] == [1, 1, 3, 1, 1]
    assert one(spark, "", text.readability(T())["reading_level"]) == "unknown"
    assert one(spark, "", text.language(T())["language"]) == "unknown" and one(spark, "zz", text.language(T())["language"]) == "english"


DOC = "# Title\nIntro words that are long enough.\n\n## Part\n1. First point\n- a\n- b\n* c\n\n| x | y |\n| 1 | 2 |\n| 3 | 4 |\nEnd\n# Last\nBye now"


def test_structure(spark):
    docs = spark.createDataFrame([(1, DOC)], "doc_id int, text string")
    assert [(r.level, r.title) for r in structure.headings(docs).orderBy("position").collect()] == [(1, "Title"), (2, "Part"), (2, "First point"), (1, "Last")]
    assert [(r.n_items, r.list_type) for r in structure.list_runs(docs).collect()] == [(4, "numbered")]
    assert [(r.start_line, r.n_rows) for r in structure.table_runs(docs).collect()] == [(9, 3)]
    ends = {r.title: DOC[r.start : r.end] for r in structure.sections(docs).collect()}
    assert ends["Title"].endswith("End\n") and ends["Last"] == "# Last\nBye now"


def brute_pack(parts, limit, carry):
    done, cur, size = [], [], 0
    for p in parts:
        if size + len(p) > limit and cur:
            done.append(cur)
            cur = (cur[-carry:] if carry else []) + [p]
            size = sum(map(len, cur))
        else:
            cur = cur + [p]
            size += len(p)
    return done + ([cur] if cur else [])


def test_sentence_and_paragraph_chunks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    parts = {r.doc_id: r.s for r in docs.select("doc_id", text.sentences(F.col("text")).alias("s")).collect()}
    got = {(r.doc_id, r.k): r.content for r in chunking.by_sentences(docs, chunking.ChunkConfig(400, 50, 25)).collect()}
    assert got == {(d, k): " ".join(c) for d, s in parts.items() for k, c in enumerate(brute_pack(s, 400, 1))}
    got = {(r.doc_id, r.k): r.content for r in chunking.by_paragraphs(docs, chunking.ChunkConfig(1000, 100, 50), "\n").collect()}
    lines = {r.doc_id: [x for x in (y.strip(" \t\n\r\f\x0b") for y in r.text.split("\n")) if len(x) > 20] for r in docs.collect()}
    assert got == {(d, k): "\n\n".join(c) for d, s in lines.items() for k, c in enumerate(brute_pack(s, 1000, 1))}


def test_chunk_helpers(spark):
    assert one(spark, "abcdef", chunking.at_boundaries(T(), F.array(F.lit(2), F.lit(4)), 2)) == ["ab", "cd", "ef"]
    assert one(spark, "abcdef", chunking.at_boundaries(T(), F.array(F.lit(1)), 9)) == ["abcdef"]
    assert one(spark, "at 3, then 12 or 900", chunking.parsed_boundaries(T(), F.lit(100))) == [3, 12]
    with pytest.raises(ValueError):
        chunking.ChunkConfig(100, 10, 100)
    with pytest.raises(ValueError):
        chunking.chunk(spark.createDataFrame([], "doc_id int, text string"), "none")


def test_vector_search(spark):
    rows = [(i, [1.0, i / 10.0], i % 2) for i in range(10)] + [(10, None, 0), (11, [0.0, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = search.top_k(v, [1.0, 0.0], 3, 0.9).collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(0, 1), (1, 2), (2, 3)]
    batch = search.top_k_batch(v, v.filter("vec_id in (0, 5)"), 2, None)
    found = {(r.query_id, r["rank"]): r.id for r in batch.collect()}
    unit = {i: (1 / (1 + i * i / 100) ** 0.5, i / 10 / (1 + i * i / 100) ** 0.5) for i in range(10)}
    for q in (0, 5):
        others = sorted((i for i in unit if i != q), key=lambda i: (-round(unit[q][0] * unit[i][0] + unit[q][1] * unit[i][1], 6), i))
        assert [found[q, 1], found[q, 2]] == others[:2]
    blocks = search.top_k_batch(v, v.filter("vec_id < 6"), 2, None, max_bytes=40)
    assert blocks.count() == 12
    assert search.remove(v, v.filter("vec_id < 3").select("vec_id")).count() == 9
    assert search.upsert(v, v.filter("vec_id = 0")).count() == 12 and search.append(v, v).count() == 24


def test_state_helpers(spark):
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i // 4, i), i % 3) for i in range(12)], "event_id long, ts timestamp_ntz, user_id long")
    gone = {r.event_id for r in state.over_size(events, 5, F.lit(1), ["ts", "event_id"]).collect()}
    assert gone == set(range(7))
    assert {r.user_id for r in state.least_recent(events, 1).collect()} == {0, 1}
    assert one(spark, "Hi {name}, {{x}} {other}", state.render(T(), {"name": F.lit("you")})) == "Hi you, {x} {other}"
    assert one(spark, "{a} {b}", state.missing_variables(T(), ["a"])) == ["b"]


def test_records(spark):
    assert one(spark, "see [12] and (7), not [x]", text.numbered_references(T())) == ["12", "7"]
    assert one(spark, "http://a.b/ http://bit.ly/1.2.3.4 http://9.8.7.6/x", text.suspicious_links(T())) == ["http://bit.ly/1.2.3.4", "http://9.8.7.6/x"]
    left, right = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))
    assert one(spark, "x", text.merged(left, right)) == {"a": 1, "b": 3} and one(spark, "x", text.merged(left, right, "p_")) == {"a": 1, "b": 2, "p_b": 3}
    assert [one(spark, s, text.question_fault(T())) for s in (" \t", "a" * 501, "Who?")] == ["empty", "too_long", None]
    assert [one(spark, s, claims.complies(T(), F.lit(50), F.lit("Pune"))) for s in ("age above 60", "age below 60", "network hospital", "any")] == [False, True, True, True]
    assert [one(spark, "x", text.duration_label(F.lit(v))) for v in (0.25, 12.34, 125.5)] == ["250ms", "12.3s", "2m 5.5s"]


def test_windows_snap_to_sentence_ends(spark):
    body = "".join(f"Sentence number {i} has a few words in it. " for i in range(60)) + "x" * 900
    docs = spark.createDataFrame([(1, body), (2, "short."), (3, "  "), (4, None)], "doc_id int, text string")
    rows = sorted((r.k, r.start, r.end, r.content) for r in chunking.snapped(docs, chunking.ChunkConfig(400, 50, 40), 100).filter("doc_id = 1").collect())
    assert rows[0][1] == 0 and rows[-1][2] == len(body) and all(b[1] == a[2] - 40 for a, b in zip(rows, rows[1:]))
    assert all(c == body[s:e] and e - s <= 400 for _, s, e, c in rows) and all(c.endswith(".") for _, s, e, c in rows if e < 2000)
    assert {r.doc_id for r in chunking.snapped(docs).collect()} == {1, 2}
    with pytest.raises(ValueError):
        chunking.snapped(docs, chunking.ChunkConfig(200, 50, 50))


def test_page_sections_over_page_breaks(spark):
    pages = [(1, 1, "before any heading\n1. Scope Of Cover\nfirst line"), (1, 2, "second line of it\n\nGENERAL TERMS\nDefinitions:\n  a term  "), (1, 3, ""), (2, 1, None), (None, 1, "TITLE LINE\nlost"), (3, 1, "no heading here at all, only text")]
    got = structure.page_sections(spark.createDataFrame(pages, "doc_id int, page int, text string")).orderBy("doc_id", "section").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "1. Scope Of Cover", 1, 2, 2, 6, "first line\nsecond line of it"),
        (1, 3, "Definitions:", 2, 2, 1, 2, "a term")]  # GENERAL TERMS has no line below it
    assert structure.page_sections(spark.createDataFrame([], "doc_id int, page int, text string")).count() == 0


def test_structure_summary_of_odd_texts(spark):
    text = "# One\n## Two\n- a\n- b\n\nA paragraph that is long enough.\n\n| a | b |\n| 1 | 2 |\n1. x"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (None, text)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in structure.structure_summary(docs).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert (r["n_headings"], r["n_lists"], r["n_items"], r["n_tables"], r["n_sections"], r["deepest"], r["hierarchical"], r["several_sections"]) == (3, 2, 3, 1, 3, 2, True, True)
    for i in (2, 3):
        assert (got[i]["n_headings"], got[i]["n_paragraphs"], got[i]["n_items"], got[i]["deepest"], got[i]["hierarchical"]) == (0, 0, 0, None, False)


@pytest.mark.parametrize("t,want", [("", "unknown"), (None, "unknown"), ("zzz", "english"), ("El perro no se va de la casa", "spanish"), ("être et avoir, le père", "french"), ("it is within the thing", "english")])
def test_mail_language(spark, t, want):
    assert one(spark, t, text.mail_language(T())) == want


def test_logged_list(spark):
    got = one(spark, ",".join(["my password", "x" * 300] + ["y"] * 20), text.logged_list(F.split(T(), ",")))
    assert len(got) == 10 and got[0] == "[REDACTED]" and got[1] == "x" * 197 + "..." and got[2] == "y"
