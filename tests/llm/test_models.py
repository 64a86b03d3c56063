import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import langid, quality, queries

from .odd import TEXTS, documents, empty

SF = "/root/testdata/sf0.01"


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    size = quality._WORDS + 3
    m = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(0, 0.3, (size, 4)), np.zeros(3), np.ones(3))
    at, x, dense = np.array([3, 70, 900]), np.array([0.5, 0.2, 0.8]), np.array([0.1, -0.4, 0.7])
    i, v = m.inputs(at, x, dense)
    z = m.w0 + v @ m.w[i] + sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(6) for b in range(a))
    assert m.score(at, x, dense) == pytest.approx(1 / (1 + np.exp(-z)))


def test_factors_learn_an_interaction():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(400):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b]), np.ones(2), np.zeros(1)))
        y.append(float(a == b))
    m = quality.train(rows, np.array(y), epochs=60, rate=0.2)
    assert np.mean([(m.score(*r) > 0.5) == (t > 0.5) for r, t in zip(rows, y)]) > 0.95


def test_quality_on_held_out_rows(spark):
    got = queries.op2_quality_fm(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 50 and got["score"].between(0, 1).all()
    assert ((held["score"] >= 0.3) == (held["predicted"] == 1)).all()
    pairs = [(a > b) + (a == b) / 2 for a in held[held["quality"] == 1]["score"] for b in held[held["quality"] == 0]["score"]]
    assert np.mean(pairs) > 0.95 and (held["predicted"] == held["quality"]).mean() > 0.9


def test_quality_of_odd_documents(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (14, 0), (12, 1), (3, 0), (2, 0), (None, 1), (99, 1), (9, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels, ["n_chars"], epochs=2).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.gone == "y" for r in got)
    assert len({r.score for r in got if r.doc_id == 9}) == 1
    nulls = docs.withColumn("n_chars", F.lit(None).cast("long"))
    assert all(0 <= r.score <= 1 for r in quality.classify(nulls, labels, ["n_chars"], epochs=1).collect())
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0


def test_languages_on_held_out_rows(spark):
    got = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 150 and got["score"].between(0, 1).all()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert held["score"].mean() == pytest.approx((held["lang_pred"] == held["lang"]).mean(), abs=0.05)


def test_languages_of_odd_documents(spark):
    docs = documents(spark)
    got = langid.identify(docs, docs, max_train=50).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.gone == "y" for r in got)
    und = {(r.text, r.lang_pred) for r in got if r.lang_pred == "und"}
    assert und == {(t, "und") for _, t, _, _ in TEXTS if not any(map(str.isalpha, t or ""))}
    assert {r.lang_pred for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(empty(spark), docs, max_train=50).count() == 0


def test_weights_are_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    vectors = [(np.array([i % 2, 5 + rng.integers(0, 50)]), np.array([0.8, 0.6])) for i in range(200)]
    w, _ = langid.ftrl(vectors, [i % 2 for i in range(200)], 2, 2, 1.0, 1.0, 0.5, 0.01)
    assert (w != 0).mean() < 0.01 and w[0, 0] > 0 > w[1, 0]
    z, y = rng.normal(size=(4000, 3)), None
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert langid.calibrate(z * 4, y) == pytest.approx(4, rel=0.15)


def test_grams_of_blocks_are_those_of_the_whole(monkeypatch):
    text = "Ein längerer Text mit ñ, é und 文字. " * 90
    at, n = langid.gram_counts(text)
    monkeypatch.setattr(langid, "_BLOCK", 100)
    again = langid.gram_counts(text)
    assert at.tolist() == again[0].tolist() and n.tolist() == again[1].tolist()
    assert n.sum() == 3 * len(text) - 3
