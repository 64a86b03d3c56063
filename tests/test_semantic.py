"""Chunks at proposed boundaries, and the catalogue of prompt templates."""

import time

from pyspark.sql import functions as F

from clausemill.operators import chunking, state


def chunks(spark, rows, least=3, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string, response string")
    docs = docs.withColumns({"start": F.lit("clash"), "content": F.lit("clash"), "k": F.lit(0), "p": F.lit(0)}) if extra else docs
    return sorted(tuple(r) for r in chunking.semantic(docs, least=least).collect())


def test_boundaries_of_an_answer(spark):
    got = chunks(spark, [(1, "abcdef  ghijkl", "cut at 6, 8, 6, 0 and 500"), (2, "abcdef", "no numbers")])
    assert got == [(1, 0, 0, 6, "abcdef"), (1, 1, 8, 14, "ghijkl"), (2, 0, 0, 6, "abcdef")]


def test_blank_lines_without_an_answer(spark):
    assert chunks(spark, [(1, "first part\n\nx\n\nsecond part", None)]) == [(1, 0, 0, 12, "first part"), (1, 1, 15, 26, "second part")]


def test_nulls_empty_texts_other_alphabets_and_repeated_rows(spark):
    rows = [(1, None, "3"), (2, "", "3"), (3, "ab", None), (None, "äöü€😀x", "3"), (4, "same same", "4"), (4, "same same", "4")]
    got = chunks(spark, rows[:3] + rows[4:], extra=True)
    assert got == [(4, 0, 0, 4, "same")] * 2 + [(4, 1, 4, 9, "same")] * 2
    assert chunks(spark, [rows[3]]) == [(None, 0, 0, 3, "äöü"), (None, 1, 3, 6, "€😀x")]
    assert chunks(spark, []) == []


def test_pieces_put_together_are_the_text(spark, sf):
    """With no least size the spans lie end to end, whatever the answer."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.concat(F.lit("at "), F.col("doc_id") % 50, F.lit(" / "), F.col("doc_id") % 333).alias("response"))
    rows = chunking.semantic(docs, least=0).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max("end").alias("last"))
    joined = docs.filter("text IS NOT NULL").join(rows, "doc_id", "left")
    assert joined.filter("NOT (n <=> length(text) AND last <=> length(text))").count() == 0


def test_long_text_in_linear_time(spark):
    text = "some words here\n\n" * 100_000
    began = time.time()
    assert len(chunks(spark, [(1, text, None)])) == 100_000
    assert time.time() - began < 20


def test_catalogue(spark):
    all_ = state.templates(spark)
    assert all_.count() == 7 and state.templates_for(all_, "email").count() == 6
    more = state.with_template(all_, "clause_extraction", "Now {text} {{x}} {limit}", ["email"])
    assert more.count() == 7 and state.templates_for(more, "email").count() == 7 and state.templates_for(more, "pdf").count() == 6
    info = {r["name"]: r for r in state.template_info(more).collect()}
    assert info["clause_extraction"]["kinds"] == "email" and info["question_answering"]["variables"] == "question,text"
    assert state.without_template(more, "clause_extraction").count() == 6


def test_offered_without_shuffling_documents(spark):
    docs = spark.createDataFrame([(1, "pdf"), (2, None), (3, "text"), (3, "email")], "doc_id long, format string")
    out = state.offered(docs, F.col("format"), state.templates(spark))
    got = sorted((r["doc_id"], len(r["templates"])) for r in out.collect())
    assert got == [(1, 7), (2, 0), (3, 0), (3, 6)] and out.columns == ["doc_id", "format", "templates"]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
