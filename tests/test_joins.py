"""Texts are made from light rows: no plan broadcasts them, and all cores make them."""

import pytest
from pyspark.sql import functions as F

from clausemill import plans
from clausemill.operators import chunking as C
from clausemill.operators import structure as S
from clausemill.plans import samples


@pytest.mark.parametrize("name", ["chunk_records", "chunk_hybrid", "sections", "chunk_structure", "chunk_section_range_join"])
def test_texts_meet_in_no_join(spark, sf, name):
    assert "Join" not in plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_before_they_are_texts(spark, sf, monkeypatch):
    monkeypatch.setattr(samples, "TASK_ROWS", 20)
    docs = samples.load(spark, sf, samples.STRUCTURED)
    assert docs.select(F.spark_partition_id()).distinct().count() > 50
    plan = S.paragraphs(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the light rows


def test_odd_headings_and_sections(spark):
    texts = ["# a\x85", "#\x0bb\rc\n## d e", "\t1.2.  x y\x0bz  \n\x0b\n#\n 3 four", "12 " + "w" * 98 + "\n12 " + "w" * 96, "", "####### seven\n#no", "٣ no\n1 yes"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, None), (None, "# lost")], "doc_id int, text string")
    got = [tuple(r) for r in S.sections(docs).orderBy("doc_id", "start").collect()]
    assert got == [(2, 3, "x y\x0bz", 0, 19, 5), (2, 1, "four", 19, 26, 2), (3, 1, "w" * 96, 102, 201, 2), (6, 1, "yes", 5, 10, 2)]
    assert [r.title for r in S.headings(docs).filter("doc_id IS NULL").collect()] == ["lost"]
    big = spark.createDataFrame([(1, "# t\n" + "\n\n".join(["p" * 30, "q" * 80, "r" * 5, "s" * 90])), (1, "# u")], "doc_id int, text string")
    assert sorted(map(tuple, C.hybrid(big, C.ChunkConfig(60, 20, 5)).collect())) == [(1, "t", 0, 36), (1, "t", 36, 118), (1, "t", 125, 215), (1, "u", 0, 3)]


def test_kinds_of_lines_are_made_once(spark, sf):
    from clausemill.functions import constants as K

    plan = plans.queries()["clause_sections"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(K.STRUCTURES[0][1]) == 1 and plan.count(K.NUMBERINGS[0]) <= 4
    rows = spark.createDataFrame([(1, "Section 1.2 Scope\n\n 2.1.3 Deep part\nWHEREAS all\n(a) letter\nArticle IV\nPreamble of it\n7 chapter"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.line_number, r.structure_type, r.number, r.level) for r in S.clause_sections(rows).orderBy("line_number").collect()]
    assert got == [(0, "section", None, 2), (5, "article", None, 1)]


def test_a_segment_is_cut_once(spark, sf):
    plan = plans.queries()["long_boundaries"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") <= 1
    df = spark.createDataFrame([("a\n\nbc\n\n" * 3,), ("",), (None,)], "text string")
    assert [r.b for r in df.select(C.long_boundaries(F.col("text"), 10, 5).alias("b")).collect()] == [[3, 7, 10, 14, 17], [], None]
