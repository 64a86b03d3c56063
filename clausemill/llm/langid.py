"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader and elastic-net penalties, then calibrated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, give_back, tidy

BITS = 15
UNKNOWN = "und"
#: A name of this operator's own.
_GUESS = "_langid_guess"
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Below U+0250 what is not a letter counts as a space; other code points stay.
_FOLD = np.array([ord(chr(i).lower()) if chr(i).isalpha() and len(chr(i).lower()) == 1 else 32 for i in range(0x250)], np.uint32)
_BLOCK = 1 << 18


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the text's 1- to 3-grams and their counts, over the whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    total, few = None, None
    for s in range(0, len(points), _BLOCK):
        x = points[max(0, s - 2) : s + _BLOCK]
        x = np.where(x < 0x250, _FOLD[np.minimum(x, 0x24F)], x)
        lead = min(s, 2)
        grams = []
        h = np.zeros(len(x), np.uint32)
        for k in range(3):
            h = (h[: len(x) - k] + x[k:] * _K[k] + np.uint32(k + 1)) * np.uint32(0x27D4EB2F)
            h ^= h >> np.uint32(15)
            grams.append(h[max(0, lead - k) :] >> np.uint32(32 - BITS))
        idx = np.concatenate(grams)
        if len(points) < 1500:
            few = np.unique(idx, return_counts=True)
        else:
            c = np.bincount(idx, minlength=1 << BITS)
            total = c if total is None else total + c
    if few is not None:
        return few
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """Classes, idf by bucket, weights (buckets x classes, mostly zero), bias, temperature."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = gram_counts(text)
        v = n * self.idf[at]
        return at, v / (np.sqrt(v @ v) or 1.0)

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest class and its calibrated probability; ('und', 0) without a letter."""
        if not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(*self.vector(text)) / self.temperature
        p = np.exp(z - z.max())
        i = int(p.argmax())
        return self.classes[i], float(p[i] / p.sum())


def ftrl(vectors: list, labels: list[int], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal on softmax loss; l1 and l2 make the elastic net."""
    z = np.zeros(((1 << BITS) + 1, classes))
    n = np.zeros_like(z)

    def weights(rows):
        zz = z[rows]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2)
        return np.where(np.abs(zz) > l1, w, 0.0)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            at, v = vectors[i]
            at, v = np.append(at, 1 << BITS), np.append(v, 1.0)
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = np.outer(v, p)
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that gives held-back rows the least log loss."""
    def loss(t):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels]).mean())

    grid = np.geomspace(0.05, 5.0, 60)
    return float(min(grid, key=loss)) if len(labels) else 1.0


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many texts hold each bucket's n-grams, over all rows; one row a task and bucket."""
    def run(batches):
        df = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    df[gram_counts(t)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, label: str = "lang", max_train: int = 6000, max_classes: int = 1000, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, calibration: int = 5) -> Model:
    """Train on (doc_id, text, ``label``); rows with a null label or no letter are not used.

    Class and document frequencies come from all rows. The weights are fitted on a sample of
    about ``max_train`` rows (never more than twice that reach the driver, as n-gram counts),
    spread evenly over the classes and chosen by hash, equal rows once; every ``calibration``-th of
    them is held back for the temperature. No rows: a model without classes, which calls every text
    'und'. More than ``max_classes`` classes raise an error: the weights of so many aren't bounded.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(label).cast("string").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()}
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    classes = sorted(counts)
    if not classes:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    idf = np.log((1.0 + sum(counts.values())) / (1.0 + document_frequencies(rows))) + 1.0
    share = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(min(1.0, max_train / len(classes) / counts[c])))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(chance < F.try_element_at(share, F.col("label"))).dropDuplicates(["doc_id", "text", "label"])
    sample = sample.withColumn("chance", chance)

    def features(batches):
        for batch in batches:
            texts, labels, chances = (batch.column(c).to_pylist() for c in ("text", "label", "chance"))
            got = [(label, *gram_counts(t), c) for t, label, c in zip(texts, labels, chances) if has_letter(t)]
            if got:
                yield pa.record_batch([pa.array([g[0] for g in got]), pa.array([g[1].astype(np.int32).tobytes() for g in got]), pa.array([g[2].astype(np.int32).tobytes() for g in got]), pa.array([g[3] for g in got])], names=["label", "at", "n", "chance"])

    found = sample.select("text", "label", "chance").mapInArrow(tidy(features), "label string, at binary, n binary, chance double")
    got = sorted(tuple(r) for r in found.orderBy("chance").limit(2 * max_train).select("label", "at", "n").collect())
    order = np.random.default_rng(3).permutation(len(got))
    vectors, labels = [], []
    for i in order:
        name, at, n = got[i]
        got[i] = None
        at = np.frombuffer(at, np.int32)
        v = np.frombuffer(n, np.int32) * idf[at]
        vectors.append((at, v / np.sqrt(v @ v)))
        labels.append(classes.index(name))
    back = [i for i in range(len(vectors)) if i % calibration == 0 and len(vectors) > calibration]
    train = sorted(set(range(len(vectors))).difference(back))
    w, b = ftrl([vectors[i] for i in train], [labels[i] for i in train], len(classes), epochs, alpha, beta, l1, l2)
    model = Model(classes, idf, w.astype(np.float32), b)
    if back:
        model.temperature = calibrate(np.array([model.logits(*vectors[i]) for i in back]), np.array([labels[i] for i in back]))
    del got, vectors
    give_back()
    return model


def predict(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score) of each whole text; null texts and texts without a letter are
    ('und', 0)."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        m = held.value
        got = [m.predict(t) for t in texts.to_pylist()]
        give_back()
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, train: DataFrame, **options) -> DataFrame:
    """``docs`` with lang_pred and score, by a model fitted on ``train`` (doc_id, text, lang).

    Only ``text`` enters a prediction. Columns called lang_pred or score are replaced; repeated
    rows get equal results; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    model = fit(train, **options)
    out = docs.drop("lang_pred", "score").withColumn(_GUESS, predict(docs["text"], model, docs.sparkSession))
    return out.withColumns({"lang_pred": F.col(f"{_GUESS}.lang_pred"), "score": F.col(f"{_GUESS}.score")}).drop(_GUESS)
