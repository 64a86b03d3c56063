import json
import random

import pytest
from pyspark.sql import functions as F

from clausemill.functions import metadata as M


def merge(a, b):
    if not isinstance(a, dict) or not isinstance(b, dict):
        return b
    return {**a, **{k: merge(a[k], v) if k in a else v for k, v in b.items()}}


def count(d):
    return sum(count(v) if isinstance(v, dict) else 1 for v in d.values())


def paths(d, at="$"):
    return [x for k, v in d.items() for x in (paths(v, f"{at}.{k}") if isinstance(v, dict) else [(f"{at}.{k}", v)])]


def made(rng, depth):
    return {k: made(rng, depth - 1) if depth and rng.random() < 0.5 else rng.choice([1, "x", None, True, [1, {"in": 2}], 2.5, {}]) for k in rng.sample("abcdé", rng.randint(0, 4))}


def test_merge_counts_and_leaves_of_any_shape(spark):
    rng = random.Random(7)
    rows = [(i, made(rng, 4), made(rng, 4)) for i in range(120)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in rows], "i int, a string, b string").select("i", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    got = df.select("i", F.to_json(M.deep_merge(F.col("a"), F.col("b"))).alias("m"), M.leaf_count(F.col("a")).alias("n"), M.leaves(F.col("b")).alias("l")).collect()
    for r in got:
        _, a, b = rows[r.i]
        assert json.loads(r.m) == merge(a, b) and r.n == count(a)
        assert sorted((x.path, json.dumps(json.loads(x.value))) for x in r.l) == sorted((p, json.dumps(v)) for p, v in paths(b))


def test_odd_sides(spark):
    df = spark.sql("SELECT parse_json('{\"a\":1}') AS o, parse_json('3') AS n, CAST(NULL AS VARIANT) AS z, parse_json('null') AS j")
    m = lambda a, b: F.to_json(M.deep_merge(F.col(a), F.col(b)))
    assert tuple(df.select(m("o", "n"), m("n", "o"), m("o", "z"), m("z", "o"), m("o", "j"), m("z", "z")).first()) == ("3", '{"a":1}', '{"a":1}', '{"a":1}', "null", None)
    assert tuple(df.select(M.leaf_count(F.col("n")), M.leaf_count(F.col("z")), M.leaf_count(F.parse_json(F.lit("{}")))).first()) == (None, None, 0)
    assert df.select(M.leaves(F.col("n")).alias("l"), M.leaves(F.col("z")).alias("z")).first() == (None, None)


def test_deep_objects_are_refused_not_cut(spark):
    deep = json.dumps({"a": {"b": {"c": {"d": 1}}}})
    df = spark.createDataFrame([(deep,)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(M.leaf_count(F.col("v"), 4)).first()[0] == 1
    for c in (M.leaf_count(F.col("v"), 2), M.leaves(F.col("v"), 2), M.deep_merge(F.col("v"), F.col("v"), 2)):
        with pytest.raises(Exception, match="nested deeper"):
            df.select(c).collect()


def test_probes(spark):
    rows = [(b"%PDF-1.4\n\xff", "none", "1.4", "binary"), (b"PK\x03\x04", "zip", None, "binary"), (b"plain", "none", None, "ascii"), ("é".encode(), "none", None, "utf-8"), (b"\xff\xfe", "none", None, "unknown"), (b"", "none", None, "ascii")]
    df = spark.createDataFrame([(r[0],) for r in rows], "c binary")
    got = [tuple(r) for r in df.select(*M.probes(F.col("c")).values()).collect()]
    assert got == [r[1:] for r in rows]


def test_document_has_all_groups_and_odd_texts(spark):
    df = spark.createDataFrame([("# Head\n\n1. one\n2. two\n\nSome words here.",), ("",)], "t string")
    got = df.select(M.document(F.col("t"), F.lit("s"), F.lit(None).cast("string"), F.lit(2), F.lit(True)).alias("m")).select(F.to_json("m").alias("j")).collect()
    first = json.loads(got[0].j)
    assert set(first) == {"source", "document", "content_analysis", "technical", "structure", "security", "quality", "accessibility"}
    assert first["structure"]["has_headings"] and first["structure"]["has_lists"] and json.loads(got[1].j)["technical"]["n_bytes"] == 0


def test_format_parts(spark):
    df = spark.createDataFrame([("pdf", "{}"), ("docx", '{"tables_count":2,"styles_used":["A"],"document_properties":{"title":"T"}}'), ("email", '{"headers":{"from":"a@b"},"structure":{"has_html":true},"attachments":[1,2]}'), ("text", "{}"), ("pdf", None)], "k string, j string")
    got = [json.loads(r.f) if r.f else None for r in df.select(F.to_json(M.format_specific(F.col("k"), F.try_parse_json("j"))).alias("f")).collect()]
    assert got[0]["pdf_version"] == "Unknown" and got[0]["page_count"] == 0 and not got[0]["has_images"]
    assert got[1]["title"] == "T" and got[1]["tables_count"] == 2 and got[1]["styles_used"] == ["A"]
    assert got[2]["from_address"] == "a@b" and got[2]["has_html_content"] and got[2]["attachment_count"] == 2 and got[3] is None and got[4]["pdf_version"] == "Unknown"
