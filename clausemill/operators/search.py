"""Exact vector search: top-k, batches of queries, upserts and deletes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def top_k(vectors: DataFrame, query: list[float], k: int = 5, threshold: float | None = 0.1, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors most like ``query`` by cosine, ranked from 1; the threshold comes after
    the cut, and ``where`` (on metadata) before it. Ties go by id. Each partition keeps its own
    k best before they meet. Rows with null or not finite vectors are left out."""
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.try_divide(V.dot(F.col(vector_col), q), V.norm(F.col(vector_col)) * V.norm(q))
    best = rows.select(F.col(id_col), score.alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), F.col(id_col)).limit(k)
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(id_col))))
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = 0.1, exclude_self: bool = True, max_bytes: int = 64 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for every row of ``queries`` against all vectors.

    Query vectors are held by every task, so their bytes are checked: beyond ``max_bytes`` they
    are taken in blocks, a pass each. A task multiplies slices of its vectors with all queries,
    a matrix of at most ``max_bytes`` / 2 at a time, and passes on its k best of each query; a window
    over those picks the result. Ties go by id. Rows whose id or vector is null or whose vector isn't
    finite are left out on either side; a zero vector scores 0.
    """
    good = lambda df: df.filter(F.col(id_col).isNotNull() & V.finite(F.col(vector_col)))
    held = good(queries).select(F.col(id_col).cast("long").alias("id"), V.doubles(F.col(vector_col)).alias("v"))
    n, most = held.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    blocks = -(-n * (most or 1) * 8 // max_bytes)
    best = None
    for b in range(blocks):
        got = held.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if len(got):
            part = _best_of_block(good(vectors), got, k, exclude_self, max_bytes // 2, id_col, vector_col)
            best = part if best is None else best.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def _unit(rows: list) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in rows])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _best_of_block(vectors: DataFrame, queries: pd.DataFrame, k: int, exclude_self: bool, max_bytes: int, id_col: str, vector_col: str) -> DataFrame:
    """The k best of each query in each task."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries["id"].to_numpy(np.int64), _unit(list(queries["v"]))))

    def run(frames):
        ids, unit = shared.value
        score, best = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
        step = max(1, max_bytes // (8 * len(ids)))
        for f in frames:
            f = f.sort_values("id")
            for a in range(0, len(f), step):
                v_ids = f["id"].to_numpy(np.int64)[a : a + step]
                s = unit @ _unit(list(f["v"].iloc[a : a + step])).T
                if exclude_self:
                    s[ids[:, None] == v_ids[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score, best = np.hstack([score, np.take_along_axis(s, top, 1)]), np.hstack([best, v_ids[top]])
                order = np.lexsort((best, -score), axis=1)[:, :k]
                score, best = np.take_along_axis(score, order, 1), np.take_along_axis(best, order, 1)
        q, at = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"query_id": ids[q], "id": best[q, at], "score": score[q, at]})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), V.doubles(F.col(vector_col)).alias("v"))
    return rows.mapInPandas(run, "query_id long, id long, score double")


def remove(vectors: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return vectors.join(ids, id_col, "left_anti")


def append(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; an id that stands in both stays twice."""
    return vectors.unionByName(new)


def upsert(vectors: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows of ``new`` replace those of the same id."""
    return new.unionByName(vectors.join(new.select(id_col).distinct(), id_col, "left_anti"))


def quality(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Counts of vectors that aren't finite or have no length, and the dimensions found."""
    v = F.col(vector_col)
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.size(v)).alias("n_dims"), F.sum((~V.finite(v)).cast("long")).alias("n_not_finite"), F.sum((V.norm(v) < 1e-6).cast("long")).alias("n_zero"))


def mean_pairwise_cosine(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Mean cosine of all pairs by (|sum of unit vectors|^2 - n) / (n (n - 1)): one pass."""
    unit = vectors.select(F.posexplode(V.normalise(F.col(vector_col))).alias("i", "x"))
    sums = unit.groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select("n", F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


def similarity_report(vectors: DataFrame, warn_above: float = 0.95, vector_col: str = "embedding") -> DataFrame:
    """n, the mean length of the vectors, the mean cosine of all pairs, and whether that is so high
    that the vectors tell too little apart. One vector alone has no mean cosine and no warning."""
    good = vectors.filter(V.finite(F.col(vector_col)) & (V.norm(F.col(vector_col)) >= 1e-6))
    lengths = good.agg(F.lit(None).cast("long").alias("n"), F.avg(V.norm(F.col(vector_col))).alias("mean_norm"), F.lit(None).cast("double").alias("mean_cosine"))
    mean = mean_pairwise_cosine(good, vector_col).select("n", F.lit(None).cast("double").alias("mean_norm"), F.when(F.col("n") > 1, F.col("mean_cosine")).alias("mean_cosine"))
    both = mean.unionByName(lengths).agg(*[F.max(c).alias(c) for c in ("n", "mean_norm", "mean_cosine")])
    return both.withColumn("warning", F.coalesce(F.col("mean_cosine") > warn_above, F.lit(False)))


def index_info(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    n, d = F.count(F.lit(1)), F.max(F.size(vector_col))
    return vectors.agg(n.alias("n_vectors"), d.alias("dimension"), (n * d * 4).alias("n_bytes"), F.when(n < 1000, "flat").when(n < 10000, "ivf").otherwise("hnsw").alias("index_type"))


def with_chunks(found: DataFrame, chunks: DataFrame, id_col: str = "vec_id", cut: int = 200) -> DataFrame:
    """Search results with their chunk (chunk_id, text) cut to ``cut`` characters and the score to
    three digits; a result without a chunk is called unknown and has an empty text."""
    c = chunks.select(F.col("chunk_id"), F.left("text", F.lit(cut)).alias("chunk_text"))
    rows = found.join(c, F.col(id_col) == F.col("chunk_id"), "left")
    name = F.coalesce(F.col("chunk_id").cast("string"), F.concat(F.lit("unknown_"), F.col(id_col).cast("string")))
    return rows.select("rank", name.alias("chunk"), F.round("score", 3).alias("score"), F.coalesce("chunk_text", F.lit("")).alias("text"))


#: Edges that one task joins, at most about.
TASK_EDGES = 500_000


def related(clauses: DataFrame, edges: DataFrame) -> DataFrame:
    """(clause_id, related_id, relation, direction) along reference edges (src, dst, relation) in
    both directions; ends that are no clauses are left out. Edges meet the clauses once for each end and
    are turned round afterwards. Their rows shrink to a few bytes in a shuffle, which would make a
    task's share large: partitions are counted by rows."""
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // TASK_EDGES))
    known = clauses.select(F.col("clause_id").alias("known")).repartition(tasks, "known").distinct()
    for end in ("src", "dst"):
        edges = edges.repartition(tasks, end)
        edges = edges.join(known, edges[end] == known["known"], "left_semi")
    way = lambda a, b, name: F.struct(F.col(a).alias("clause_id"), F.col(b).alias("related_id"), "relation", F.lit(name).alias("direction"))
    return edges.select(F.explode(F.array(way("src", "dst", "to"), way("dst", "src", "from"))).alias("x")).select("x.*")
