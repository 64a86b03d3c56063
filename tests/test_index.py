import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.operators import ann, pairs, search


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def clustered(n=1200, groups=12, d=16, seed=5):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, d))


def spark_files(df):
    """Files that the scan of ``df`` lists after partition pruning."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value()


def best(v, queries, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[queries] @ u.T
    s[np.arange(len(queries)), queries] = -9
    return {(int(q), int(i)) for q, row in zip(queries, s) for i in np.argsort(-row, kind="stable")[:k]}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    v = clustered()
    path = str(tmp_path_factory.mktemp("index"))
    return v, frame(spark, v), ann.build(frame(spark, v), path, lists=12, parts=4, codes=64), path


def test_clusters_need_few_probes(spark, made):
    v, df, index, _ = made
    queries = df.filter("vec_id % 20 = 0")
    probes = ann.tune_probes(index, queries, 10, 0.95)
    got = {(r["query_id"], r["id"]) for r in ann.top_k_batch(index, queries, 10, probes).collect()}
    true = best(v, np.arange(0, len(v), 20), 10)
    assert probes <= 6 and len(got & true) >= 0.95 * len(true)
    assert {(r["query_id"], r["id"]) for r in ann.top_k_batch(index, queries, 10, 12).collect()} == true


def test_blocks_of_queries_give_the_same(made):
    _, df, index, _ = made
    queries = df.filter("vec_id % 50 = 0")
    one = ann.top_k_batch(index, queries, 5, 4)
    many = ann.top_k_batch(index, queries, 5, 4, max_bytes=1500)
    rows = lambda x: sorted((r["query_id"], r["rank"], r["id"]) for r in x.collect())
    assert rows(one) == rows(many) and len(rows(one)) == 5 * 24


def test_only_near_lists_are_read(made):
    v, _, index, path = made
    near = index.order((v[:1] / np.linalg.norm(v[0])))[0][:2]
    got = ann.top_k(index, v[0].tolist(), 5, probes=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and all(str(x) in plan.split("PartitionFilters:")[1].split("]")[0] for x in near)
    opened = spark_files(index.table().filter(F.col("list").isin([int(x) for x in near])))
    assert opened < len(index.table().inputFiles()) and opened <= sum(len(os.listdir(f"{path}/lists/list={x}")) for x in near)
    assert got.first()["id"] == 0 and [r["rank"] for r in got.collect()] == [1, 2, 3, 4, 5]


def test_every_row_is_indexed_and_kept_whole(spark, made):
    v, df, index, path = made
    again = ann.load(spark, path)
    assert np.allclose(again.centroids, index.centroids) and np.allclose(again.books, index.books)
    rows = {r["id"]: r for r in again.table().collect()}
    assert sorted(rows) == list(range(len(v)))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(np.allclose(rows[i]["v"], u[i], atol=1e-15) and len(rows[i]["code"]) == 4 for i in rows)
    near = ((u[:, None] - index.centroids[None]) ** 2).sum(2).argmin(1)
    assert all(rows[i]["list"] == near[i] for i in rows)


def test_codes_find_nine_tenths_and_read_no_vectors(made):
    v, df, index, _ = made
    true = best(v, np.arange(0, len(v), 20), 10)
    got = {(r["query_id"], r["id"]) for r in ann.top_k_codes(index, df.filter("vec_id % 20 = 0"), 10, candidates=100).collect()}
    assert len(got & true) >= 0.9 * len(true) and len(got) == len(true)
    assert index.table().select("id", "code")._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].count("v:") == 0


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [0.6, 0.8]), (8, [0.6, 0.8]), (9, [1.0, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(df, str(tmp_path / "odd"), lists=2)
    assert sorted(r["id"] for r in index.table().collect()) == [1, 2, 8, 8, 9]
    got = ann.top_k_batch(index, df, 3, 2)
    assert {(r["query_id"], r["id"]) for r in got.filter("rank = 1").collect()} >= {(1, 9), (9, 1)}
    with pytest.raises(ValueError):
        ann.build(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        ann.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema), str(tmp_path / "mixed"))
    with pytest.raises(ValueError):
        ann.top_k_codes(index, df)


def test_defaults_and_bands():
    assert [ann.default_lists(n, 384) for n in (5, 1000, 5000, 10**6, 10**9)] == [5, 96, 96, 1000, 4096]
    assert pairs.bands_for(1.0, 12, 0.99) == 1 and pairs.bands_for(0.9, 8, 0.9999) > pairs.bands_for(0.95, 8, 0.9999)


@pytest.mark.parametrize("block", [2000, 7])
def test_pairs_equal_all_pairs(spark, block):
    """With small blocks hot bands are cut into cells; copies, zero and odd vectors are among the rows."""
    v = clustered(260, 8, 12, 9)
    v[200:230] = v[200]
    v[230] = 0
    df = frame(spark, v).unionByName(spark.createDataFrame([(None, [1.0] * 12), (900, None), (901, [float("nan")] * 12)], "vec_id long, embedding array<double>"))
    got = {(r["a"], r["b"]): r["cosine"] for r in pairs.similar_pairs(df, 0.93, block=block, bits=5).collect()}
    keep = [i for i in range(260) if not 201 <= i <= 230]
    u = v[keep] / np.linalg.norm(v[keep], axis=1, keepdims=True)
    s = u @ u.T
    want = {(keep[i], keep[j]): s[i, j] for i, j in zip(*np.nonzero(np.triu(s >= 0.93, 1)))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 500
    members = {r["id"]: r["class_id"] for r in pairs.classes(df).collect()}
    assert len(members) == 259 and {members[i] for i in range(200, 230)} == {200} and 230 not in members
    n = {r["id"]: r["n_links"] for r in pairs.links(pairs.similar_pairs(df, 0.93, bits=5), pairs.classes(df)).collect()}
    whole = v[[i for i in range(260) if i != 230]]
    whole = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    assert n == {i: int(c) - 1 for i, c in zip([i for i in range(260) if i != 230], (whole @ whole.T >= 0.93).sum(1))}


def test_pairs_of_nothing(spark):
    assert pairs.similar_pairs(frame(spark, np.zeros((3, 4))), 0.9).count() == 0
    with pytest.raises(ValueError):
        pairs.similar_pairs(frame(spark, np.ones((3, 4))), 0.0)


def test_similarity_warning(spark):
    v = np.ones((5, 4)) + 0.01 * np.random.default_rng(1).normal(size=(5, 4))
    assert search.similarity_report(frame(spark, v)).first()["warning"]
    r = search.similarity_report(frame(spark, v[:1])).first()
    assert r["n"] == 1 and r["mean_cosine"] is None and not r["warning"]
