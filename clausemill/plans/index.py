"""Approximate search, codes and pairs of similar vectors over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ann, pairs, search
from ..sources import scratch
from ..sources.tables import table

K, TARGET, PARTS = 10, 0.9, 16


def _built(spark, d, parts=None):
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 20 = 0"), ann.build(v, scratch.folder(spark, "vector-index") + "/index", parts=parts)


def ivf_search(spark, d):
    """Best 10 of the lists that reach nine tenths of the true neighbours of a bounded set of queries."""
    _, queries, index = _built(spark, d)
    probes = ann.tune_probes(index, queries, K, 0.95)
    return ann.top_k_batch(index, queries, K, probes).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _reached(found, exact):
    return ann.recall(found, exact).select(F.lit(K).alias("k"), "n_true", (F.col("n_found") >= TARGET * F.col("n_true")).alias("reached"))


def ivf_recall(spark, d):
    v, queries, index = _built(spark, d)
    found = ann.top_k_batch(index, queries, K, ann.tune_probes(index, queries, K, 0.95))
    return _reached(found, search.top_k_batch(v, queries, K, None))


def ivf_all_lists(spark, d):
    """With every list probed the index gives the exact result."""
    _, queries, index = _built(spark, d)
    return ann.top_k_batch(index, queries, K, len(index.centroids)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def ivf_topk(spark, d):
    """One query against the lists nearest to it, all of them here: its result is exact."""
    v, _, index = _built(spark, d)
    one = v.filter("vec_id = 0").select("embedding").first()
    return ann.top_k(index, list(one[0]) if one else [], 5, len(index.centroids), 0.1).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def ivf_lists(spark, d):
    """Every vector lies in one list, with its codes, a byte for each part."""
    v, _, index = _built(spark, d, PARTS)
    rows = index.table()
    return rows.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_distinct("id").alias("n_ids"), F.sum(F.size("v") * 4).alias("n_bytes"), F.sum(F.length("code")).alias("n_code_bytes"), F.sum(F.col("list").isNull().cast("int")).cast("long").alias("n_without_list"))


def pq_search(spark, d):
    _, queries, index = _built(spark, d, PARTS)
    return ann.top_k_codes(index, queries, K).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def pq_recall(spark, d):
    v, queries, index = _built(spark, d, PARTS)
    return _reached(ann.top_k_codes(index, queries, K), search.top_k_batch(v, queries, K, None))


def _near_copies(spark, d):
    """The vectors, and each once more with a quarter of the next one added."""
    v = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("embedding"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    moved = v.join(after, "vec_id").select((-F.col("vec_id") - 1).alias("vec_id"), F.zip_with("embedding", "other", lambda x, y: x + y * 0.25).alias("embedding"))
    return v.unionByName(moved)


def similar_pairs(spark, d):
    return pairs.expanded_pairs(_near_copies(spark, d), 0.9).select("a", "b", F.round("cosine", 6).alias("cosine"))


def similar_links(spark, d):
    """The same with every fifth vector there twice more: copies are one class, and count."""
    rows = _near_copies(spark, d)
    copies = rows.filter("vec_id % 5 = 0").select(F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 1_000_000, F.col("vec_id") + 2_000_000)).alias("vec_id"), "embedding")
    table_ = rows.filter("vec_id % 5 <> 0").unionByName(copies)
    return pairs.links(pairs.similar_pairs(table_, 0.9), pairs.classes(table_))


def similarity_report(spark, d):
    return search.similarity_report(table(spark, d, "embeddings")).select("n", F.round("mean_norm", 6).alias("mean_norm"), F.round("mean_cosine", 6).alias("mean_cosine"), "warning")


QUERIES = {f.__name__: f for f in (ivf_search, ivf_recall, ivf_all_lists, ivf_topk, ivf_lists, pq_search, pq_recall, similar_pairs, similar_links, similarity_report)}

_E = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"
_TRUE = f"""WITH v AS ({_E}), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
_COUNT = f"{_TRUE} SELECT {K} AS k, count(*) AS n_true, true AS reached FROM t WHERE rank <= {K}"
_NEAR = f"""WITH e AS ({_E}), near AS (SELECT * FROM e UNION ALL SELECT -a.vec_id - 1, list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] + 0.25 * b.e[i]) FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"""
SQL = {
    "ivf_recall": _COUNT,
    "pq_recall": _COUNT,
    "ivf_all_lists": f"{_TRUE} SELECT query_id, id, round(score, 6) AS score, rank FROM t WHERE rank <= {K}",
    "ivf_topk": f"""WITH v AS ({_E}), s AS (SELECT v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q WHERE q.vec_id = 0),
        t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s) SELECT vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 5 AND score >= 0.1""",
    "ivf_lists": f"SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, sum(len(embedding) * 4)::BIGINT AS n_bytes, (count(*) * {PARTS})::BIGINT AS n_code_bytes, 0::BIGINT AS n_without_list FROM embeddings",
    "similar_pairs": f"{_NEAR} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM near a, near b WHERE a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9",
    "similar_links": f"""{_NEAR}, x AS (SELECT vec_id, e FROM near WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id + k * 1000000, e FROM near, range(3) r(k) WHERE vec_id % 5 = 0),
        c AS (SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY e) AS class_id, e FROM x)
        SELECT id, class_id, (SELECT count(*) FROM x b WHERE b.vec_id <> c.id AND list_cosine_similarity(b.e, c.e) >= 0.9) AS n_links FROM c""",
    "similarity_report": f"""WITH v AS ({_E}), m AS (SELECT avg(list_cosine_similarity(a.e, b.e)) AS c FROM v a, v b WHERE a.vec_id <> b.vec_id)
        SELECT (SELECT count(*) FROM v) AS n, (SELECT round(avg(sqrt(list_sum(list_transform(e, lambda x: x * x)))), 6) FROM v) AS mean_norm, round(c, 6) AS mean_cosine, c > 0.95 AS warning FROM m""",
}
