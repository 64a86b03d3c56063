"""Operators over one long text or document: right against brute force, and in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clausemill.operators import chunking as C
from clausemill.operators import preprocess as P
from clausemill.operators import structure as S


def took(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def test_twenty_thousand_headings(spark):
    rng = random.Random(2)
    levels = [rng.randint(1, 6) for _ in range(20_000)]
    text = "\n".join(f"{'#' * n} Heading {i}\nsome words" for i, n in enumerate(levels))
    df = spark.createDataFrame([(1, text), (None, "# lost"), (2, "no heading"), (3, "# a\n### b\n## c\n1.2.3.4 Deep one\n# d")], "doc_id long, text string")
    held = []
    assert took(lambda: held.extend(S.sections(df).collect())) < 20
    rows = sorted((r for r in held if r.doc_id == 1), key=lambda r: r.start)
    starts = [r.start for r in rows]
    for i in range(0, 20_000, 97):
        end = next((starts[j] for j in range(i + 1, 20_000) if levels[j] <= levels[i]), len(text))
        assert rows[i].level == levels[i] and rows[i].end == end and rows[i].n_words == len([w for w in text[rows[i].start : end].split() if w])
    assert [(r.title, r.start, r.end) for r in sorted((r for r in held if r.doc_id == 3), key=lambda r: r.start)] == [("a", 0, 32), ("b", 4, 10), ("c", 10, 32), ("Deep one", 15, 32), ("d", 32, 35)]


def test_snapped_windows_of_a_long_text(spark):
    text = "A sentence of some words, é and more of them. Another one? " * 40_000
    df = spark.createDataFrame([(1, text), (2, "x" * 5000), (3, "  ")], "doc_id long, text string")
    held = []
    assert took(lambda: held.extend(C.snapped(df).select("doc_id", "k", "start", "end", F.length("content").alias("n")).collect())) < 20
    one = sorted((r for r in held if r.doc_id == 1), key=lambda r: r.k)
    assert one[-1].end == len(text) and all(a.end - 50 == b.start for a, b in zip(one, one[1:])) and all(r.n == r.end - r.start and text[r.end - 1] in ".?" for r in one[:-1])
    assert [(r.start, r.end) for r in sorted((r for r in held if r.doc_id == 2), key=lambda r: r.k)] == [(0, 1000), (950, 1950), (1900, 2900), (2850, 3850), (3800, 4800), (4750, 5000)] and not [r for r in held if r.doc_id == 3]


def intervals(rng, n, top):
    out = []
    for _ in range(n):
        a = rng.randint(0, top)
        out.append((rng.choice([1, 2]), a, a + rng.randint(0, top // 3), f"t{rng.randint(0, 99)}"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_section_that_holds_a_place(spark, seed):
    rng = random.Random(seed)
    secs = [(d, s, e, f"{t}-{i}") for i, (d, s, e, t) in enumerate(intervals(rng, 25, 60))]
    secs = list({(d, s, e): (d, s, e, t) for d, s, e, t in secs}.values()) + [(None, 0, 90, "null")]
    places = [(rng.choice([1, 2, 3, None]), rng.randint(-2, 90)) for _ in range(120)]
    got = C.containing_section(spark.createDataFrame(places, "doc_id int, start int"), spark.createDataFrame(secs, "doc_id int, start int, end int, title string"))
    want = {(d, x): min(((s, e, t) for dd, s, e, t in secs if d is not None and dd == d and s <= x <= e), default=(0, 0, None))[2] for d, x in places}
    assert {(r.doc_id, r.start): r.section for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_pages_of_places(spark, seed):
    rng = random.Random(seed)
    pages, at = [], 3
    for k in range(40):
        end = at + rng.randint(0, 9)
        pages.append((1, k, at, end))
        at = end + rng.choice([0, 0, 2])
    pages += [(2, 7, 0, 5), (None, 1, 0, 99)]
    places = [(rng.choice([1, 2, None]), rng.randint(-1, at + 4), f"x{i}") for i in range(150)] + [(1, None, "n"), (1, 5, "same"), (1, 5, "same")]
    got = C.page_of(spark.createDataFrame(places, "doc_id int, position int, extra string"), spark.createDataFrame(pages, "doc_id int, page int, start int, end int"))
    want = [(d, x, e, next((p for dd, p, a, b in pages if d is not None and dd == d and x is not None and a <= x < b), None)) for d, x, e in places]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["doc_id", "position", "extra", "page"]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_places_in_one_document(spark):
    n = 60_000
    places, pages = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 7).cast("int").alias("position")), spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"), (F.col("id") * 7).cast("int").alias("start"), (F.col("id") * 7 + 7).cast("int").alias("end"))
    held = []
    assert took(lambda: held.append(C.page_of(places, pages).filter("page * 7 = position").count())) < 20 and held == [n]


def test_borders(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("abé", k=rng.randint(0, 14))), "".join(rng.choices("abé", k=rng.randint(0, 14)))) for _ in range(300)] + [("aaaa", "aaaaaa"), ("x\U0001f600é", "\U0001f600éy"), ("", "a"), (None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", C.text_overlap(F.col("a"), F.col("b"), 9).alias("n")).collect()
    for r in got:
        assert r.n == (max((i for i in range(min(len(r.a), len(r.b), 9) + 1) if r.a[len(r.a) - i :] == r.b[:i]), default=0) if r.a is not None else 0)
    shared = "".join(rng.choices("abcdefgh", k=9_000))
    df = spark.createDataFrame([("z" * 9000 + shared, shared + "y" * 9000)], "a string, b string")
    held = []
    assert took(lambda: held.append(df.select(C.text_overlap(F.col("a"), F.col("b"), 10_000)).first()[0])) < 15 and held == [9000]


def test_figures_come_from_the_pass_itself(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Words  with odd spaces, and enough of them. " * 60), (2, "short"), (3, None), (4, "  "), (5, "Plain words that stay.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    stages = P.Stages()
    chunks = P.preprocess(spark.read.parquet(str(tmp_path / "d")), stages)
    assert chunks._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    chunks.write.parquet(str(tmp_path / "c"))
    f = stages.figures()
    assert (f["read"]["n"], f["read"]["n_blank"], f["valid"]["n"], f["normalised"]["n_changed"]) == (5, 2, 2, 1) and f["chunked"]["n"] == spark.read.parquet(str(tmp_path / "c")).count() == 4
    s = P.summary(f)
    assert (s["n_documents"], s["n_kept"], s["stages_completed"], s["mean_batch"]) == (5, 2, 4, 4.0) and 0 < s["reduction_percent"] < 10 and P.faults(f) == ["most_rejected"]
    assert stages.report(docs).filter("stage = 'chunked' AND figure = 'n'").first().value == 4.0
    with pytest.raises(ValueError):
        stages.watch(docs, "read")
    none = P.Stages()
    P.preprocess(docs.limit(0), none).write.format("noop").mode("overwrite").save()
    assert P.faults(none.figures()) == ["nothing_read"] and P.summary(none.figures())["mean_batch"] == 0.0
