"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

A document is described by statistics of its whole text.  ``cos(x W + b)`` with random W
approximates a Gaussian kernel over them (Rahimi and Recht 2007), so ridge regression on these
features is approximate kernel ridge regression.  Its normal equations are sums over documents:
each partition of labelled rows gives one small matrix, Spark adds them up, and the driver
solves a system whose size is the number of features.  Isotonic regression on the training
scores (pool adjacent violators over a histogram) turns ridge scores into probabilities.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Byte classes that are counted: upper case, lower case and non-ASCII, digits, space, line ends,
#: sentence marks, bars, other symbols.
_CLASS = np.full(256, 7, np.int64)
_CLASS[ord("A"):ord("Z") + 1] = 0
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'-\"()"]] = 5
_CLASS[ord("|")] = 6
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
N_STATS = 18


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; shares are damped so that very short texts don't swing."""
    data = (text or "").encode("utf-8")
    n = len(data)
    if not n:
        return [0.0] * N_STATS
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=8)
    words = data.split()
    k = len(words)
    lengths = np.fromiter(map(len, words), np.float64, k) if k else np.zeros(1)
    again = sum(map(operator.eq, words, words[1:]))
    distinct = len(set(words))
    ends = sum(w[-1] in _SYMBOLS for w in words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = by_class[0] + by_class[1]
    tail = sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines)
    return [
        math.log1p(n), math.log1p(k), by_class[0] / (letters + 5), by_class[2] / (n + 5), by_class[3] / (n + 5),
        by_class[4] / (n + 5), by_class[5] / (n + 5), by_class[6] / (k + 2), by_class[7] / (n + 5), again / (k + 5),
        distinct / (k + 1), math.log1p(distinct) / math.log1p(k + 1), float(lengths.mean()), float(lengths.std()),
        ends / (k + 2), tail / (len(lines) + 1), math.log1p(k / (len(lines) + 1)), len(set(lines)) / (len(lines) + 1),
    ]


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray   # calibration: score -> probability, linear between the edges
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), x, np.cos(x @ self.w + self.b) * math.sqrt(2 / len(self.b))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``y`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def text_statistics(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, out_col: str = "stats") -> DataFrame:
    def compute(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]

    return common.with_columns(docs, [(out_col, T.ArrayType(T.DoubleType()))], text_col, compute, carry)


def _summed(df: DataFrame, columns: list[str], terms) -> np.ndarray:
    """Sum over the rows of the matrix that ``terms(batch arrays)`` makes: one matrix for each
    partition, added up by Spark element by element."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = terms(*[b.column(i) for i in range(b.num_columns)])
                total = m if total is None else total + m
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], ["i", "v"])

    rows = df.select(*columns).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(rows["i"].max()) + 1 if len(rows) else 0)
    out[rows["i"].to_numpy()] = rows["v"].to_numpy()
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), N_STATS)


def fit(sample: DataFrame, n_features: int = 256, width: float = 6.0, ridge: float = 1e-3, bins: int = 512, seed: int = 7) -> Model | None:
    """The model of labelled statistics (columns label, stats); None without both labels."""
    def moments(label: pa.Array, stats: pa.Array) -> np.ndarray:
        x, y = _matrix(stats), label.to_numpy(zero_copy_only=False).astype(float)
        return np.stack([np.full(N_STATS, len(x), float), x.sum(0), (x * x).sum(0), np.full(N_STATS, y.sum())])

    m = _summed(sample, ["label", "stats"], moments)
    if not len(m):
        return None
    n, s1, s2, y1 = m.reshape(4, N_STATS)
    if not 0 < y1[0] < n[0]:
        return None
    mean = s1 / n
    scale = np.sqrt(np.maximum(s2 / n - mean * mean, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / width, (N_STATS, n_features)), rng.uniform(0, 2 * math.pi, n_features),
                  np.zeros(0), np.zeros(0), np.zeros(0))

    def normal(label: pa.Array, stats: pa.Array) -> np.ndarray:
        a = model.features(_matrix(stats))
        return a.T @ np.column_stack([a, label.to_numpy(zero_copy_only=False).astype(float)])

    k = 1 + N_STATS + n_features
    eq = _summed(sample, ["label", "stats"], normal).reshape(k, k + 1)
    model.beta = np.linalg.solve(eq[:, :k] + ridge * n[0] / k * np.eye(k), eq[:, k])

    def histogram(label: pa.Array, stats: pa.Array) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(stats)) + 1) / 3 * bins).astype(int), 0, bins - 1)  # scores lie about 0 and 1
        y = label.to_numpy(zero_copy_only=False).astype(float)
        return np.stack([np.bincount(at, minlength=bins).astype(float), np.bincount(at, weights=y, minlength=bins)])

    count, positive = _summed(sample, ["label", "stats"], histogram).reshape(2, bins)
    used = np.flatnonzero(count)
    model.edges = (used + 0.5) / bins * 3 - 1
    model.values = np.clip(isotonic(positive[used] / count[used], count[used]), 0, 1)
    return model


def train(docs: DataFrame, labels: DataFrame, in_training: Column, max_rows: int = 20_000) -> Model | None:
    """Fit on at most ``max_rows`` labelled documents that ``in_training`` admits."""
    sample = common.labelled_sample(docs, labels, "quality", in_training, max_rows)
    return fit(common.written(text_statistics(sample, "text", ["label"]), "quality-sample"))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None,
          score_col: str = "score") -> DataFrame:
    """``docs`` (or its columns ``carry``) with the probability of good quality of every whole text.

    NULL and empty texts have all statistics 0 and are scored as such.  Without a model (no
    labelled rows of both kinds) every score is 1: nothing is known against a document."""
    shared = common.broadcast_value(docs.sparkSession, model)  # a few hundred kilobytes, whatever the table

    def compute(texts: list[str | None]) -> list[pa.Array]:
        m = shared.value
        p = np.ones(len(texts)) if m is None or not texts else m.probability(np.array([statistics(t) for t in texts]))
        return [pa.array(p, pa.float64())]

    return common.with_columns(docs, [(score_col, T.DoubleType())], text_col, compute, carry)


def classify(docs: DataFrame, labels: DataFrame, in_training: Column, max_rows: int = 20_000, threshold: float = 0.7,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document.  Repeated rows get equal results, other columns are
    ignored, empty tables give empty results."""
    out = score(docs.select(id_col, text_col), train(docs, labels, in_training, max_rows), text_col, [id_col])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
