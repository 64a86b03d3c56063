"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy
from .shingles import text_buffer, words_by_text

WORD_BITS = 14
_WORDS = 1 << WORD_BITS
STATISTICS = ("log_words", "log_chars", "word_length", "upper", "digits", "marks", "odd_marks", "line_length", "distinct", "top_word", "wide_bytes", "repeats")
_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 usual mark, 5 other mark, 6 blank, 7 line end, 8 not ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 4 if chr(_c) in ".,;:!?'\"-()" else 5
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 6, 7, 8


def statistics(raw: np.ndarray, words: np.ndarray, counts: np.ndarray) -> list[float]:
    """``STATISTICS`` of one text from its bytes, word hashes and word counts."""
    n, w = len(raw), len(words)
    k = np.bincount(_KIND[raw], minlength=9) if n else np.zeros(9, np.int64)
    letters = max(1, k[1] + k[2] + k[8])
    return [np.log1p(w), np.log1p(n), (n - k[6] - k[7]) / max(1, w), k[1] / letters, k[3] / max(1, n), k[4] / max(1, w), k[5] / max(1, w),
            np.log1p(w / (k[7] + 1)), len(counts) / max(1, w), (counts.max() / w if w else 0.0), k[8] / max(1, n), float((words[1:] == words[:-1]).mean()) if w > 1 else 0.0]


def features(column: pa.Array, metadata: list[np.ndarray]):
    """(word buckets, their values, statistics and metadata) of each text, over whole texts.
    Word values are counts, scaled to length 1; metadata m enters as log(1 + max(m, 0))."""
    raw, off = text_buffer(column)
    for i, words in words_by_text(column):
        h, c = np.unique(words, return_counts=True)
        at, inv = np.unique(h >> np.uint64(64 - WORD_BITS), return_inverse=True)
        v = np.bincount(inv, c, len(at)) if len(at) else np.zeros(0)
        v = v / (np.sqrt(v @ v) or 1.0)
        yield at.astype(np.int64), v, np.array(statistics(raw[off[i] : off[i + 1]], words, c) + [m[i] for m in metadata])


def _numbers(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    out = []
    for m in names:
        x = np.array([np.nan if v is None else float(v) for v in batch.column(m).to_pylist()])
        out.append(np.log1p(np.maximum(np.nan_to_num(x, nan=0.0, posinf=1e18), 0.0)))
    return out


@dataclass
class FactorisationMachine:
    """w0 + w.x + (sum_f (v_f.x)^2 - (v_f^2).(x^2)) / 2: all pairs of inputs interact through
    their factors, in time linear in the inputs that aren't zero."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, at, x, dense):
        d = np.clip((dense - self.mean) / self.scale, -4.0, 4.0)
        return np.concatenate([at, _WORDS + np.arange(len(d))]), np.concatenate([x, d])

    def score(self, at, x, dense) -> float:
        at, x = self.inputs(at, x, dense)
        v = self.v[at]
        s = x @ v
        z = self.w0 + x @ self.w[at] + 0.5 * (s @ s - ((v * v).T @ (x * x)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple], labels: np.ndarray, factors: int = 8, epochs: int = 12, rate: float = 0.05, l2: float = 1e-4, batch: int = 64) -> FactorisationMachine:
    """AdaGrad on log loss over mini-batches; ``rows`` as ``features`` gives them."""
    dense = np.array([r[2] for r in rows])
    size = _WORDS + dense.shape[1]
    rng = np.random.default_rng(17)
    m = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, factors)), dense.mean(0), dense.std(0) + 1e-6)
    data = [m.inputs(*r) for r in rows]
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            at = np.concatenate([data[i][0] for i in pick])
            x = np.concatenate([data[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(data[i][0]) for i in pick])
            first = np.searchsorted(row, np.arange(len(pick)))
            vx = m.v[at] * x[:, None]
            sums = np.add.reduceat(vx, first)
            z = m.w0 + np.add.reduceat(m.w[at] * x, first) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), first))
            err = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            used, inv = np.unique(at, return_inverse=True)
            dw = np.bincount(inv, err[row] * x, len(used)) + l2 * m.w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, inv, (err[row] * x)[:, None] * (sums[row] - vx))
            dv += l2 * m.v[used]
            d0 = err.sum()
            g0 += d0 * d0
            m.w0 -= rate * d0 / np.sqrt(g0)
            gw[used] += dw * dw
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv * dv
            m.v[used] -= rate * dv / np.sqrt(gv[used])
    return m


def fit(labelled: DataFrame, metadata: Sequence[str] = (), label: str = "quality", **options) -> FactorisationMachine | None:
    """Fit on (text, ``label`` 0 or 1, ``metadata`` numbers): a sample whose size the caller has
    bounded. Features are made on the executors; None without rows of both labels."""
    def run(batches):
        for b in batches:
            got = [(y, a.astype(np.int32).tobytes(), v.tobytes(), d.tobytes()) for y, (a, v, d) in zip(b.column("y").to_pylist(), features(b.column("text"), _numbers(b, metadata)))]
            if got:
                yield pa.record_batch([pa.array([g[k] for g in got], pa.int64() if k == 0 else pa.binary()) for k in range(4)], names=["y", "at", "v", "d"])

    rows = labelled.filter(F.col(label).isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col(label).cast("long").alias("y"), *metadata)
    got = sorted(tuple(r) for r in rows.mapInArrow(tidy(run), "y long, at binary, v binary, d binary").collect())
    y = np.array([g[0] for g in got], float)
    if len(set(y)) < 2:
        return None
    return train([(np.frombuffer(g[1], np.int32), np.frombuffer(g[2]), np.frombuffer(g[3])) for g in got], y, **options)


def score(docs: DataFrame, model: FactorisationMachine | None, metadata: Sequence[str] = ()) -> Column:
    """The score (0 to 1) of each whole text; 0.5 without a model. Null text scores as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(*cols: pa.Array) -> pa.Array:
        m = held.value
        if m is None:
            return pa.array([0.5] * len(cols[0]), pa.float64())
        b = pa.record_batch(list(cols), names=["text", *metadata])
        return pa.array([m.score(*f) for f in features(cols[0], _numbers(b, metadata))], pa.float64())

    return run(F.coalesce(docs["text"], F.lit("")), *[docs[m].cast("double") for m in metadata])


def classify(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = (), label: str = "quality", max_train: int = 8000, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` (doc_id, text, ``metadata`` columns) with score and predicted.

    ``labels`` (doc_id, ``label``) are the rows to learn from: a hash sample of about
    ``max_train`` ids (at most twice as many, which is what is broadcast), joined to their
    documents; of several labels or texts of an id one counts, the least by value. The score sees the text and the metadata only. Null metadata count as 0; null and empty texts are
    scored as empty; repeated rows score alike; columns called score or predicted are replaced;
    an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    n = known.count()
    chance = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.filter(chance < min(1.0, max_train / max(1, n))).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = few.withColumn("chance", chance).orderBy("chance", "doc_id").limit(2 * max_train).select("doc_id", "label")
    texts = docs.select("doc_id", "text", *metadata).join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label", *metadata)).alias("x")).select("x.*")
    model = fit(one, metadata, "label", **options)
    out = docs.withColumn("score", score(docs, model, metadata))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
