"""Toxicity by a classifier chain over sparse word features.

The chain predicts three categories in turn, by logistic regression on the words and word stems a text holds:
  toxic_junk   toxic and of low quality
  toxic_prose  toxic and of high quality
  toxic        any toxicity
Each later model also sees the earlier categories' probabilities. In training these come from out-of-fold predictions,
so a later model learns how far an earlier one can be trusted on texts that it has not seen. A document is rejected if
the last category's probability reaches the threshold.

The models are fitted on at most MAX_TRAIN labelled documents (a documented bound), those with the least
xxhash64(doc_id), in one task that holds their texts and gives back the model; every document is scored over its whole
text.

Defined cases: null or empty text has no features and scores at the intercept; labels with nulls are not used; repeated
doc_ids are scored each; without any usable labels every probability is 0 and nothing is rejected; toxic_filter keeps
all columns as they are, also those named like a category, while score_documents replaces these.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

CATEGORIES = ("toxic_junk", "toxic_prose", "toxic")
MAX_TRAIN = 6000
FOLDS = 3
THRESHOLD = 0.5
#: A feature is used if it is in MIN_DF training texts and its count in some category is MIN_Z deviations off.
MIN_DF = 8
MIN_Z = 6.0
STEMS = (4, 5, 6, 7)
BUCKET_BITS = 20
L2 = 1e-2
EPOCHS = 60
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[str]:
    """The distinct words of a text, and for each the stems of STEMS letters, with a star: a stem counts once for each word."""
    found = set(_WORD.findall((text or "").lower()))
    out = list(found)
    for k in STEMS:
        out += [w[:k] + "*" for w in found if len(w) > k]
    return out


def length(found: list[str]) -> float:
    """The only feature beside words: long texts hold any word more easily."""
    return float(np.log1p(len(found)))


class Sparse:
    """Rows of feature numbers, kept flat."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.cols = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def take(self, keep: np.ndarray) -> "Sparse":
        out, place = Sparse.__new__(Sparse), np.cumsum(keep) - 1
        on = keep[self.row]
        out.n, out.cols, out.row = int(keep.sum()), self.cols[on], place[self.row[on]]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.cols], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.cols, g[self.row], size)


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights of the sparse features, the dense ones and the intercept: Adam on the L2-penalised log loss, rare class weighted up by the root of its odds."""
    k = dense.shape[1]
    w, m, v = np.zeros(size + k + 1), np.zeros(size + k + 1), np.zeros(size + k + 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, np.sqrt((1 - rate) / rate), 1.0)
    weight /= weight.sum()
    w[-1] = np.log(rate / (1 - rate))
    for step in range(1, EPOCHS + 1):
        g = (probability(x, dense, w, size) - y) * weight
        grad = np.concatenate([x.back(g, size), dense.T @ g, [g.sum()]]) + L2 * np.append(w[:-1], 0) / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def probability(x: Sparse, dense: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.dot(w[:size]) + dense @ w[size:-1] + w[-1], -30, 30)))


def fit_chain(texts: list[str | None], labels: np.ndarray) -> dict:
    """labels: a column for each of CATEGORIES."""
    return fit_stream(lambda: zip(texts, labels, strict=True))


def fit_stream(read) -> dict:
    """read() gives (text, labels) from the start again; three passes, so only what the models use is kept.

    The first pass counts features in hash buckets, the second the features of buckets that differ between categories,
    and the third reads the rows of the features that do. Copies would count a label many times over, so equal texts
    are one example. Returns the vocabulary (feature -> weights of all models) and the rest of the weights.
    """

    def examples():
        seen: set[bytes] = set()
        for text, y in read():
            key = hashlib.md5((text or "").encode()).digest()
            if key not in seen:
                seen.add(key)
                yield key, features(text), y

    k = len(CATEGORIES)
    buckets, n, total = np.zeros((1 << BUCKET_BITS, 1 + k), np.float32), 0, np.zeros(k)
    for _, f, y in examples():
        at = np.unique([zlib.crc32(w.encode()) & ((1 << BUCKET_BITS) - 1) for w in f]).astype(np.int64)
        buckets[at] += np.concatenate([[1], y])
        n, total = n + 1, total + y

    def telling(got: np.ndarray) -> np.ndarray:
        expected = got[..., :1] * total / max(n, 1)
        far = np.abs(got[..., 1:] - expected) >= MIN_Z * np.sqrt(expected * (1 - got[..., :1] / max(n, 1)) + 0.25)
        return (got[..., 0] >= MIN_DF) & far.any(-1)

    # A bucket shared by several features can hide one, so half the deviation is enough to look closer.
    expected = buckets[:, :1] * total / max(n, 1)
    look = (buckets[:, 0] >= MIN_DF) & (np.abs(buckets[:, 1:] - expected) >= MIN_Z / 2 * np.sqrt(expected * (1 - buckets[:, :1] / max(n, 1)) + 0.25)).any(1)
    df: dict[str, np.ndarray] = {}
    for _, f, y in examples():
        for w in set(f):
            if look[zlib.crc32(w.encode()) & ((1 << BUCKET_BITS) - 1)]:
                if w not in df:
                    df[w] = np.zeros(1 + k, np.float32)
                df[w] += np.concatenate([[1], y])
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, got in df.items() if telling(got)))}
    del df
    rows = sorted(((key, sorted(vocabulary[w] for w in f if w in vocabulary), length(f), tuple(y)) for key, f, y in examples()), key=lambda r: r[0])
    size = len(vocabulary)
    x = Sparse([np.array(r[1], np.int64) for r in rows])
    fold = np.arange(len(rows)) % FOLDS
    labels = np.array([r[3] for r in rows], float).reshape(-1, k)
    dense, models = np.array([[r[2]] for r in rows]).reshape(-1, 1), []
    for j in range(k):
        y = labels[:, j]
        models.append(fit_logistic(x, dense, y, size))
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            on = fold != f
            w = fit_logistic(x.take(on), dense[on], y[on], size)
            out[~on] = probability(x.take(~on), dense[~on], w, size)
        dense = np.column_stack([dense, out])
    table = np.column_stack([w[:size] for w in models]) if size else np.zeros((0, k))
    return {"words": {w: tuple(table[i].tolist()) for w, i in vocabulary.items() if np.abs(table[i]).max() > 1e-3}, "dense": [w[size:-1].tolist() for w in models], "bias": [float(w[-1]) for w in models]}


class Scorer:
    """Probabilities of CATEGORIES; what a word and its stems add to each category is kept for the words seen so far."""

    MOST_KEPT = 200_000

    def __init__(self, model: dict):
        self.model, self.known = model, {}

    def adds(self, word: str) -> tuple | None:
        table = self.model["words"]
        got = [table[w] for w in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)) if w in table]
        return tuple(map(sum, zip(*got, strict=True))) if got else None

    def __call__(self, text: str | None) -> list[float]:
        found = set(_WORD.findall((text or "").lower()))
        if len(self.known) > self.MOST_KEPT:
            self.known.clear()
        for w in found:
            if w not in self.known:
                self.known[w] = self.adds(w)
        got = [g for w in found if (g := self.known[w])]
        sums = [sum(c) for c in zip(*got, strict=True)] if got else [0.0] * len(CATEGORIES)
        n = len(found) + sum(len(w) > k for w in found for k in STEMS)
        z = [float(np.log1p(n))]
        for k, bias in enumerate(self.model["bias"]):
            v = sums[k] + bias + sum(a * b for a, b in zip(self.model["dense"][k], z, strict=True))
            z.append(float(1 / (1 + np.exp(-max(-30.0, min(30.0, v))))))
        return z[1:]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict | None:
    """Fit on a bounded sample of labelled rows, at most max_train ids and max_train rows; None without usable labels. The sample's ids are few and broadcast."""
    usable = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic", F.coalesce(F.col("quality"), F.lit(0)).alias("quality"))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality"))
    # The bound holds for rows, too: a document that is there very often brings no more of them.
    rows = materialise(spark, rows.orderBy(F.xxhash64("text"), "text", "toxic", "quality").limit(max_train), "training")

    def fit(batches):
        held = [b for b in batches if b.num_rows]

        def read():
            for b in held:
                for text, t, q in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    yield text.as_py(), np.array([t & (1 - q), t & q, t])

        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_stream(read))], pa.binary())], ["model"])

    # At most max_train rows, in one task of an executor: the driver gets the model only.
    found = rows.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _scored(docs: DataFrame, model: dict | None, threshold: float, names: list[str]) -> DataFrame:
    """docs, then under the given names a probability for each category and whether it is rejected."""
    keep, at = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[:-1]), T.StructField(names[-1], T.BooleanType())])

    def run(batches):
        score = Scorer(model) if model else lambda _: [0.0] * len(CATEGORIES)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                got = [score(t.as_py()) for t in part.column(at)]
                cols = [pa.array([g[k] for g in got], pa.float64()) for k in range(len(CATEGORIES))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols, pa.array([g[-1] >= threshold for g in got], pa.bool_())], [*keep, *names])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs, then a probability for each category and rejected (boolean)."""
    own = [*CATEGORIES, "rejected"]
    return _scored(docs.select(*(c for c in docs.columns if c not in own)), model, threshold, own)


def toxic_filter(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain doesn't reject, with the columns of docs as they are."""
    names = [f"_{c}" for c in (*CATEGORIES, "rejected")]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    return _scored(docs, train(spark, docs, labels), threshold, names).filter(~F.col(names[-1])).select(*docs.columns)
