"""Vector queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search
from ..sources.tables import table


def _query_vector(vectors, vec_id):
    """The vector with an id; one without a direction, which nothing is like, if there is none."""
    rows = vectors.filter(F.col("vec_id") == vec_id).select("embedding").take(1)
    return list(rows[0][0]) if rows and rows[0][0] else []


def vector_topk(spark, d, k=5, threshold=0.1):
    v = table(spark, d, "embeddings")
    return search.top_k(v, _query_vector(v, 0), k, threshold).select("vec_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_filtered(spark, d, label=3):
    v = table(spark, d, "embeddings")
    return search.top_k(v, _query_vector(v, 0), 5, 0.0, F.col("label") == label).select("vec_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_batch(spark, d):
    v = table(spark, d, "embeddings")
    return search.top_k_batch(v, v.filter("vec_id % 20 = 0"), 5, 0.1).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def vector_normalize(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), V.normalise(F.col("embedding")).alias("u"))
    return rows.select("vec_id", "dim", F.round(F.try_element_at("u", F.lit(1)), 6).alias("first"), F.round(V.norm(F.col("u")), 6).alias("unit_norm"))


def vector_remove(spark, d):
    v = table(spark, d, "embeddings")
    return search.remove(v, v.filter("label = 1").select("vec_id")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _changed(v):
    return v.filter("label = 0").withColumn("label", F.lit(99))


def vector_append(spark, d):
    v = table(spark, d, "embeddings")
    return search.append(v, _changed(v)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


def vector_upsert(spark, d):
    v = table(spark, d, "embeddings")
    return search.upsert(v, _changed(v)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


def namespace_counts(spark, d):
    return table(spark, d, "embeddings").groupBy(F.concat(F.lit("ns"), F.col("label").cast("string")).alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


def embedding_quality(spark, d):
    return search.quality(table(spark, d, "embeddings"))


def avg_pairwise_cosine(spark, d):
    return search.mean_pairwise_cosine(table(spark, d, "embeddings")).select("n", F.round("mean_cosine", 6).alias("mean_cosine"))


def index_info(spark, d):
    return search.index_info(table(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_topk_batch, vector_normalize, vector_remove, vector_append, vector_upsert, namespace_counts, embedding_quality, avg_pairwise_cosine, index_info)}

_E = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
SQL = {
    "vector_topk": f"""WITH v AS ({_E}), s AS (SELECT v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q WHERE q.vec_id = 0),
        t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 5 AND score >= 0.1""",
    "vector_topk_filtered": f"""WITH v AS ({_E}), s AS (SELECT v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q WHERE q.vec_id = 0 AND v.label = 3),
        t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 5 AND score >= 0.0""",
    "vector_topk_batch": f"""WITH v AS ({_E}), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
        SELECT query_id, id, round(score, 6) AS score, rank FROM t WHERE rank <= 5 AND score >= 0.1""",
    "vector_normalize": f"""WITH v AS ({_E}), n AS (SELECT vec_id, len(e) AS dim, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v)
        SELECT vec_id, dim, round(e[1] / l, 6) AS first, round(sqrt(list_sum(list_transform(e, lambda x: (x / l) * (x / l)))), 6) AS unit_norm FROM n""",
    "vector_remove": "SELECT label, count(*) AS n FROM embeddings WHERE label <> 1 GROUP BY label",
    "vector_append": "SELECT label, count(*) AS n, sum(vec_id) AS ids FROM (SELECT label, vec_id FROM embeddings UNION ALL SELECT 99, vec_id FROM embeddings WHERE label = 0) GROUP BY label",
    "vector_upsert": "SELECT label, count(*) AS n, sum(vec_id) AS ids FROM (SELECT CASE WHEN label = 0 THEN 99 ELSE label END AS label, vec_id FROM embeddings) GROUP BY label",
    "namespace_counts": "SELECT 'ns' || label AS namespace, count(*) AS n FROM embeddings GROUP BY 1",
    "embedding_quality": f"""WITH v AS ({_E}) SELECT count(*) AS n, count(DISTINCT len(e)) AS n_dims, count(*) FILTER (WHERE len(list_filter(e, lambda x: isnan(x) OR isinf(x))) > 0) AS n_not_finite,
        count(*) FILTER (WHERE sqrt(list_sum(list_transform(e, lambda x: x * x))) < 1e-6) AS n_zero FROM v""",
    "avg_pairwise_cosine": f"WITH v AS ({_E}) SELECT (SELECT count(*) FROM v) AS n, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS mean_cosine FROM v a, v b WHERE a.vec_id <> b.vec_id",
    "index_info": "SELECT count(*) AS n_vectors, max(len(embedding)) AS dimension, count(*) * max(len(embedding)) * 4 AS n_bytes, CASE WHEN count(*) < 1000 THEN 'flat' WHEN count(*) < 10000 THEN 'ivf' ELSE 'hnsw' END AS index_type FROM embeddings",
}
