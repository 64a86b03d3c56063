"""Work and memory of a task that don't grow with the table, or with the square of a text."""

from pyspark.sql import functions as F

from clausemill import plans
from clausemill.functions import text as X
from clausemill.operators import chunking as C
from clausemill.operators import search
from clausemill.operators import structure as S
from clausemill.sources import mail, tables


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_are_cut_off_before_python(spark):
    body = "\r\n\r\n".join(["Subject: none of the headers"] * 5000)
    long_ = "X-Long: " + "\r\n ".join(["y" * 70] * 1500)
    raw = [f"Subject: a\r\nFrom: B <b@x.org>\r\n\r\n{body}", f"{long_}\nSubject: a\nFrom: B <b@x.org>\n\n{body}", "Subject: a\rFrom: B <b@x.org>\r\r" + body, "Subject: a\nFrom: B <b@x.org>"]
    files = spark.createDataFrame([(f"m{i}", bytearray(r.encode())) for i, r in enumerate(raw)] + [("n", None)], "path string, content binary")
    out = mail.headers(files)
    assert "regexp_instr" in plan_of(out)
    got = {r.path: (r.subject, r.from_address, r.error) for r in out.collect()}
    assert got == {**{f"m{i}": ("a", "b@x.org", None) for i in range(4)}, "n": (None, None, "TypeError")}


def test_structure_needs_no_texts(spark):
    files = spark.createDataFrame([(f"m{i}", bytearray(b"Content-Type: text/plain\r\n\r\n" + b"t" * 700_000)) for i in range(5)], "path string, content binary")
    rows = mail.parts(files, texts=False)
    assert [tuple(r) for r in rows.select(F.count("text"), F.sum("n_bytes"), F.countDistinct("path")).collect()] == [(0, 3_500_000, 5)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(2 << 20)


def test_texts_are_dealt(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "TASK_TEXTS", 5)
    assert tables.dealt(spark, sf, "documents", "doc_id").select(F.spark_partition_id()).distinct().count() > 25


def test_only_other_texts_than_ascii_go_to_python(spark):
    df = spark.createDataFrame([("é",), ("plain",), (None,), ("",)], "text string")
    out = X.with_nfc(df)
    assert "octet_length" in plan_of(out) and [r.text for r in out.collect()] == ["\xe9", "plain", None, ""]


def test_windows_are_cut_before_they_are_rows(spark):
    df = spark.createDataFrame([(1, "é" * 25), (2, " "), (3, "abc")], "doc_id int, text string")
    out = C.fixed(df, C.ChunkConfig(10, 2, 2))
    assert "substring(" in next(line for line in plan_of(out).splitlines() if "Generate" in line)
    assert sorted((r.doc_id, r.k, r.start, r.end, len(r.content)) for r in out.collect()) == [(1, 0, 0, 10, 10), (1, 1, 8, 18, 10), (1, 2, 16, 25, 9), (3, 0, 0, 3, 3)]


def test_words_and_steps_are_made_once(spark, sf):
    assert plan_of(plans.queries()["batch_list"](spark, sf)).count("split(") == 1
    assert plan_of(plans.queries()["normalize_changes"](spark, sf)).count("\\p{C}") == 1
    t = "a\x07  b –  “c”\r\nd\r"
    row = spark.createDataFrame([(t,)], "t string").select(X.changes(F.col("t")).alias("c"), F.length(X.normalise(F.col("t"))).alias("n")).first()
    assert row.c.length == row.n and tuple(row.c.counts) == (1, 2, 1, 2, 2, 1)


def test_parts_need_no_sort(spark, sf):
    plan = plan_of(plans.queries()["paragraphs"](spark, sf))
    assert not any(w in plan for w in ("Window", "Sort", "Join"))
    df = spark.createDataFrame([(1, "a b\x0bc d\n \t\n" + "w " * 15 + "\n\n"), (1, "z" * 21), (2, "")], "doc_id int, text string")
    assert sorted((r.i, r.start, r.end, r.n_words) for r in S.paragraphs(df).collect()) == [(0, 0, 21, 1), (1, 9, 38, 15)]


def test_edges_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_EDGES", 10)
    known = spark.range(0, 300, 2).select(F.col("id").alias("clause_id"))
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") % 9).alias("dst"), F.lit("r").alias("relation"))
    out = search.related(known, edges)
    want = {(a, b, w) for x in range(0, 300, 2) if x % 9 % 2 == 0 for a, b, w in ((x, x % 9, "to"), (x % 9, x, "from"))}
    assert {(r.clause_id, r.related_id, r.direction) for r in out.collect()} == want and out.rdd.getNumPartitions() == 30


def test_texts_meet_no_prices(spark, sf):
    plan = plans.queries()["token_cost"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
