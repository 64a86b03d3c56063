"""Time of vectors' functions by their dimension."""

import time

import numpy as np
from pyspark.sql import functions as F

from clausemill.functions import vectors as V
from clausemill.operators import pairs


def test_a_long_vector_has_unit_length_in_linear_time(spark):
    v = F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: (i + F.col("id")).cast("float"))
    start = time.perf_counter()
    got = spark.range(4).select(v.alias("v")).select(V.norm(V.normalise(F.col("v"))).alias("n")).collect()
    assert time.perf_counter() - start < 20 and all(abs(r.n - 1) < 1e-9 for r in got)


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, None), (3, []), (4, [1.0, None])], "id int, v array<double>")
    assert [r.u for r in rows.orderBy("id").select(V.normalise(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8], None, [], [None, None]]


def test_bands_of_a_large_table_are_few(spark):
    assert pairs.bands_for(0.9, 8, 0.9999) < 30 and pairs.MEET >= 1_000
    v = np.random.default_rng(3).normal(size=(40, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.vstack([v, v + 0.05]))], "vec_id long, embedding array<double>")
    u = np.vstack([v, v + 0.05])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if u[a] @ u[b] >= 0.9}
    assert {(r.a, r.b) for r in pairs.similar_pairs(rows, 0.9).collect()} == want
