"""Approximate vector search: an inverted-file index with optional product-quantised codes.

The index is a table partitioned by ``list``, the nearest of a set of centroids; a search reads
the lists whose centroids are nearest to the query and ranks their vectors exactly. Codes hold a
vector in a byte for each part of it; a search by codes reads these alone, then ranks the best of
them exactly. ``search.top_k`` and ``search.top_k_batch`` are the exact way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import search

_FOUND = "query_id long, id long, score double"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def _nearest(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest code of each part: (n, m, w) against (m, k, w) gives (n, m)."""
    out = np.empty(parts.shape[:2], np.int64)
    for s, book in enumerate(books):
        out[:, s] = np.argmin((book * book).sum(1)[None, :] - 2 * (parts[:, s] @ book.T), axis=1)
    return out


def _split(v: np.ndarray, m: int) -> np.ndarray:
    return v.reshape(len(v), m, -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *also: Column) -> DataFrame:
    """(id, v) and the columns ``also`` of the rows that an index holds: id and vector are there, all numbers
    are finite. Vectors have unit length; a zero vector stays one and is like nothing."""
    rows = vectors.filter(F.col(id_col).isNotNull() & V.finite(F.col(vector_col)) & (F.size(vector_col) > 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), V.normalise(F.col(vector_col)).alias("v"), *also)


def fit(rows: DataFrame, m: int, k: int, rounds: int = 8, sample: int = 65_536, seed: int = 17) -> np.ndarray:
    """Codebooks (m, k, width) by k-means on each of ``m`` equal parts of the vectors ``v``. Rounds are
    Spark jobs over a sample of about ``sample`` rows by hash, from all of the table; each task sends its sums,
    m * k * width numbers, and the driver holds the codebooks alone. A code nobody is nearest to keeps its place."""
    n = rows.count()
    keyed = rows.withColumn("_h", F.xxhash64(F.lit(seed), "id"))
    if n > sample:
        keyed = keyed.filter(F.pmod(F.col("_h"), F.lit(1 << 20)) < max(1, (sample << 20) // n))
    first = keyed.orderBy("_h", "id").limit(k).toPandas()["v"]
    if not len(first):
        raise ValueError("no vectors to fit an index to")
    seeds = _split(np.stack([np.asarray(v) for v in first]), m)
    books = np.ascontiguousarray(np.resize(seeds, (k, *seeds.shape[1:])).transpose(1, 0, 2))
    held = keyed.select("v").repartition(min(32, rows.sparkSession.sparkContext.defaultParallelism)).cache()
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def run(frames):
            books = shared.value
            sums, counts = np.zeros_like(books), np.zeros(books.shape[:2])
            for f in frames:
                if len(f):
                    parts = _split(np.stack(f["v"].to_list()), len(books))
                    near = _nearest(parts, books)
                    for s in range(len(books)):
                        np.add.at(sums[s], near[:, s], parts[:, s])
                        counts[s] += np.bincount(near[:, s], minlength=books.shape[1])
            yield pd.DataFrame({"sums": [sums.tobytes()], "counts": [counts.tobytes()]})

        got = held.mapInPandas(run, "sums binary, counts binary").collect()
        sums = sum(np.frombuffer(r["sums"]).reshape(books.shape) for r in got)
        counts = sum(np.frombuffer(r["counts"]).reshape(books.shape[:2]) for r in got)
        books = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], books)
        shared.destroy()
    held.unpersist()
    return books


def default_lists(n: int, dimension: int) -> int:
    """Lists for ``n`` vectors: their root, but at least as many as the dimension asks for (a quarter
    of it, up to 100) where there are rows enough, and at most 4,096."""
    return max(1, min(n, 4096, max(int(n**0.5), min(100, dimension // 4))))


@dataclass
class Index:
    """A saved index: its folder, centroids (lists, d), and codebooks (m, k, width) or None."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    books: np.ndarray | None

    def table(self) -> DataFrame:
        """(id, v, code, list); ``list`` is the partition column."""
        return self.spark.read.schema("id long, v array<double>, code binary, list int").parquet(f"{self.path}/lists")

    def order(self, queries: np.ndarray) -> np.ndarray:
        """All lists for each query, the nearest first."""
        d = (self.centroids**2).sum(1)[None, :] - 2 * queries @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")


def build(vectors: DataFrame, path: str, lists: int | None = None, parts: int | None = None, codes: int = 256, sample: int = 65_536, rounds: int = 8, rows_per_file: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Fit and write an index of every usable row. ``parts`` bytes of codes are stored with each
    vector (None: none). Lists are written by as many tasks as hold ``rows_per_file`` rows each, so
    a list with a third of all rows is no single task's. Vectors must share one dimension."""
    spark, rows = vectors.sparkSession, usable(vectors, id_col, vector_col)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if not shape["n"] or shape["lo"] != shape["hi"] or parts and shape["hi"] % parts:
        raise ValueError("an index needs vectors of one dimension, in equal parts")
    k = lists or default_lists(shape["n"], shape["hi"])
    centroids = fit(rows, 1, k, rounds, sample)[0]
    books = fit(rows, parts, min(codes, 256), rounds, sample) if parts else None
    shared = spark.sparkContext.broadcast((centroids, books))

    def run(frames):
        centroids, books = shared.value
        for f in frames:
            if len(f):
                v = np.stack(f["v"].to_list())
                near = _nearest(v[:, None, :], centroids[None])[:, 0]
                code = [None] * len(f) if books is None else [c.tobytes() for c in _nearest(_split(v, len(books)), books).astype(np.uint8)]
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "code": code, "list": near.astype(np.int32)})

    placed = rows.mapInPandas(run, "id long, v array<double>, code binary, list int")
    tasks = max(1, -(-shape["n"] // rows_per_file))
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(tasks)))
    salted.repartition("list", "_salt").sortWithinPartitions("list", "id").drop("_salt").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    book = spark.createDataFrame([("lists", 0, c, x.tolist()) for c, x in enumerate(centroids)] + [("codes", s, c, x.tolist()) for s, b in enumerate(books if books is not None else []) for c, x in enumerate(b)], "kind string, part int, code int, v array<double>")
    book.coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
    return Index(spark, path, centroids, books)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/books").orderBy("kind", "part", "code").collect()
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    parts = len({r["part"] for r in of("codes")})
    books = np.array([r["v"] for r in of("codes")]).reshape(parts, -1, len(of("codes")[0]["v"])) if parts else None
    return Index(spark, path, np.array([r["v"] for r in of("lists")]), books)


def top_k(index: Index, query: list[float], k: int = 5, probes: int = 10, threshold: float | None = 0.1) -> DataFrame:
    """The best ``k`` of the ``probes`` lists nearest to ``query``, ranked exactly; the other lists'
    files are not opened."""
    near = index.order(_unit(np.asarray([query], float)))[0][:probes]
    return search.top_k(index.table().filter(F.col("list").isin([int(x) for x in near])), query, k, threshold, id_col="id", vector_col="v")


def _query_blocks(queries: DataFrame, id_col: str, vector_col: str, max_bytes: int):
    """Ids and unit vectors of the queries, in blocks of at most about ``max_bytes``."""
    held = usable(queries, id_col, vector_col)
    n, d = held.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (d or 1) * 8 // max_bytes))
    for b in range(blocks):
        got = held.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if len(got):
            yield got["id"].to_numpy(np.int64), np.stack(got["v"].to_list())


class _Best:
    """The best ``k`` (score, id) of each query so far; ties go by id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (len(at), len(ids)) of the queries ``at``."""
        if score.shape[1] > self.k:
            cut = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
            keep = (score >= cut[:, None]).any(0)  # a tie with the cut stays
            score, ids = score[:, keep], ids[keep]
        s = np.hstack([self.score[at], score])
        i = np.hstack([self.id[at], np.broadcast_to(ids, score.shape)])
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self, ids: np.ndarray) -> pd.DataFrame:
        q, at = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"query_id": ids[q], "id": self.id[q, at], "score": self.score[q, at]})


def _ranked(found: list[DataFrame], spark: SparkSession, k: int) -> DataFrame:
    rows = spark.createDataFrame([], _FOUND)
    for f in found:
        rows = rows.unionByName(f)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k_batch(index: Index, queries: DataFrame, k: int = 10, probes: int = 10, exclude_self: bool = True, max_bytes: int = 64 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of every query in its ``probes`` nearest lists. Lists that no
    query asks for aren't read. Tasks hold the queries (beyond ``max_bytes`` in blocks, a pass each)
    and multiply each list's vectors with the queries that ask for it."""
    spark, found = index.spark, []
    for ids, unit in _query_blocks(queries, id_col, vector_col, max_bytes):
        near = index.order(unit)[:, :probes]
        asks = np.zeros((len(index.centroids), len(ids)), bool)
        asks[near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])] = True
        shared = spark.sparkContext.broadcast((ids, unit, asks))

        def run(frames, shared=shared):
            ids, unit, asks = shared.value
            best = _Best(len(ids), k)
            for f in frames:
                for one, g in f.groupby("list", sort=False):
                    at = np.flatnonzero(asks[one])
                    for a in range(0, len(g), step := max(1, (max_bytes // 8) // max(1, len(at)))):
                        part = g.iloc[a : a + step]
                        v_ids = part["id"].to_numpy(np.int64)
                        s = unit[at] @ np.stack(part["v"].to_list()).T
                        if exclude_self:
                            s[ids[at][:, None] == v_ids[None, :]] = -np.inf
                        best.offer(at, s, v_ids)
            yield best.rows(ids)

        lists = [int(x) for x in np.unique(near)]
        found.append(index.table().filter(F.col("list").isin(lists)).select("id", "v", "list").mapInPandas(run, _FOUND))
    return _ranked(found, spark, k)


def tune_probes(index: Index, queries: DataFrame, k: int = 10, target: float = 0.9, most: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The fewest probes that find ``target`` of the true best ``k`` of at most ``most`` queries, by
    where the exact results lie. Vectors without clusters ask for many, clustered ones for few."""
    some = queries.filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(most)
    table = index.table().select("id", "v", "list")
    exact = search.top_k_batch(table, some.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), k, None, id_col="id", vector_col="v")
    where = {(r["query_id"], r["id"]): r["list"] for r in exact.select("query_id", "id").join(table.select("id", "list"), "id").collect()}
    place = {}
    for ids, unit in _query_blocks(some, id_col, vector_col, 64 << 20):
        rank = np.argsort(index.order(unit), axis=1)
        place |= {int(q): rank[i] for i, q in enumerate(ids)}
    needed = np.sort([int(place[q][one]) + 1 for (q, _), one in where.items()])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else len(index.centroids)


def top_k_codes(index: Index, queries: DataFrame, k: int = 10, candidates: int = 200, exclude_self: bool = True, max_bytes: int = 64 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) by codes: a pass over ids and codes alone scores every vector by
    sums from a table of each query's parts with all codes, the best ``candidates`` are ranked exactly."""
    if index.books is None:
        raise ValueError("the index has no codes")
    spark, found = index.spark, []
    for ids, unit in _query_blocks(queries, id_col, vector_col, max_bytes // max(1, 256 * len(index.books) // unit_width(index))):
        tables = np.einsum("qmw,mkw->qmk", _split(unit, len(index.books)), index.books)
        shared = spark.sparkContext.broadcast((ids, tables))

        def run(frames, shared=shared):
            ids, tables = shared.value
            best = _Best(len(ids), candidates)
            for f in frames:
                for a in range(0, len(f), step := max(1, (max_bytes // 16) // len(ids))):
                    part = f.iloc[a : a + step]
                    v_ids = part["id"].to_numpy(np.int64)
                    codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                    s = np.zeros((len(ids), len(part)))
                    for m in range(codes.shape[1]):
                        s += tables[:, m, codes[:, m]]
                    if exclude_self:
                        s[ids[:, None] == v_ids[None, :]] = -np.inf
                    best.offer(np.arange(len(ids)), s, v_ids)
            yield best.rows(ids)

        found.append(index.table().select("id", "code").mapInPandas(run, _FOUND))
    near = _ranked(found, spark, candidates).select("query_id", "id")
    held = usable(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = near.join(index.table().select("id", "v"), "id").join(held, "query_id").select("query_id", "id", V.dot(F.col("q"), F.col("v")).alias("score"))
    return _ranked([exact], spark, k)


def unit_width(index: Index) -> int:
    return index.centroids.shape[1]


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_true, n_found): how many of the exact (query_id, id) pairs were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
