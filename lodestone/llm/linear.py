"""Bounded training samples and linear models in numpy, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc(column: str = "doc_id") -> Column:
    """CRC-32 of a column as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sample(docs: DataFrame, labelled: DataFrame, by: str, each: int, encode: Callable[[list], list[bytes]]) -> list[tuple[object, bytes]]:
    """About each rows at most for every value of by, chosen by a hash of doc_id: the value and the features as bytes.

    labelled: doc_id and by. The labels meet the ids without the texts; the chosen ids, a few times each, are then
    broadcast, so that no text is shuffled. The features are computed on the executors from whole texts, and only they
    come to the driver.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(by).count().collect()}
    if not counts:
        return []
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by).eqNullSafe(F.lit(value)), min(1.0, each / n)).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share * float(1 << 30)).select("doc_id", F.col(by).alias("label")).dropDuplicates(["doc_id"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], pa.array(encode(part["text"].to_pylist()), pa.binary())], ["doc_id", "label", "x"])

    kind = dict(labelled.dtypes)[by]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(made, f"doc_id long, label {kind}, x binary").collect()
    return [(r[1], bytes(r[2])) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, bytes(r[2])))]


def dense(features: Callable[[list], np.ndarray]) -> Callable[[list], list[bytes]]:
    return lambda texts: [row.tobytes() for row in features(texts).astype(np.float32)]


def undense(rows: list[tuple[object, bytes]], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x for _, x in rows), np.float32).reshape(-1, width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def adam(gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, size: int, epochs: int, rate: float, seed: int = 5, batch: int = 256) -> np.ndarray:
    """Minimise by Adam with a falling rate. gradient takes the weights and the rows of a batch."""
    rng, w = np.random.default_rng(seed), np.zeros(size)
    m, v, t, steps = np.zeros(size), np.zeros(size), 0, epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            g = gradient(w, order[k : k + batch])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, epochs: int = 40, rate: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, the last being the intercept."""
    weight = np.ones(len(y)) if weight is None else weight

    def gradient(w: np.ndarray, i: np.ndarray) -> np.ndarray:
        r = weight[i] * (sigmoid(x[i] @ w[:-1] + w[-1]) - y[i])
        return np.append(x[i].T @ r / len(i) + l2 * w[:-1], r.mean())

    return adam(gradient, len(y), x.shape[1] + 1, epochs, rate)


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, epochs: int = 30, rate: float = 0.05) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss for labels -1 and 1, the last being the intercept."""

    def gradient(w: np.ndarray, i: np.ndarray) -> np.ndarray:
        r = -2 * y[i] * np.maximum(0, 1 - y[i] * (x[i] @ w[:-1] + w[-1]))
        return np.append(x[i].T @ r / len(i) + l2 * w[:-1], r.mean())

    return adam(gradient, len(y), x.shape[1] + 1, epochs, rate)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept with sigmoid(slope * z + intercept) fitted to labels 0 and 1 by Newton's method."""
    spread = max(float(np.std(z)), 1e-6)
    x = np.c_[(z - z.mean()) / spread, np.ones(len(z))]
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2), x.T @ (p - t) + 1e-4 * w)
    return float(w[0] / spread), float(w[1] - w[0] * z.mean() / spread)
