"""A quality classifier by positive-unlabelled learning.

With g the score, l(z) = log(1 + exp(-z)) and prior the share of good texts, the non-negative unbiased risk is

    prior * E[l(g) | trusted good] + max(0, E[l(-g) | unlabelled web text] - prior * E[l(-g) | trusted good])

whose gradient turns round while the estimate of the bad part is below zero, which keeps the model from overfitting
(Kiryo et al. 2017). Features describe form alone: shapes of neighbouring characters, repetition, lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, table, word_hashes
from lodestone.llm.linear import adam, crc, dense, platt, sample, sigmoid, undense

#: Trusted, unlabelled and (for calibration alone) bad rows that a fit uses, at most (about).
EACH = 2500
THRESHOLD = 0.7

_MARKS = b".,!?#$%&*|-_\"'():;/"
CLASSES = 6 + len(_MARKS) + 1
_CLASS = np.full(256, CLASSES - 1, np.uint8)
_CLASS[32] = _CLASS[9] = 0
_CLASS[10] = _CLASS[13] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
for _k, _mark in enumerate(_MARKS):
    _CLASS[_mark] = 6 + _k
_RUNS, _DENSE = 512, 12
WIDTH = CLASSES * CLASSES + _RUNS + _DENSE


def features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        n = len(data)
        if not n:
            continue
        c = _CLASS[data].astype(np.int64)
        row[: CLASSES * CLASSES] = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) / n)
        r = c[np.r_[True, c[1:] != c[:-1]]].astype(np.uint32)
        if len(r) > 2:
            h = ((r[:-2] << 10 | r[1:-1] << 5 | r[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 9)
            row[CLASSES * CLASSES : -_DENSE] = np.sqrt(np.bincount(h, minlength=_RUNS) / len(r))
        w = word_hashes(text)
        k = max(1, len(w))
        _, counts = np.unique(w, return_counts=True)
        lines = [x for x in text.split("\n") if x.strip()]
        row[-_DENSE:] = (
            np.log1p(n) / 10, np.log1p(len(w)) / 10, n / k / 20, len(counts) / k, counts.max(initial=0) / k, (w[1:] == w[:-1]).sum() / k,
            np.sqrt((w[1:] == w[:-1]).sum() / k), (counts == 1).sum() / k, (c == 3).sum() / n, len(set(lines)) / max(1, len(lines)), len(lines) / k, (c >= 6).sum() / n,
        )
    return out


class Model:
    """Weights on standardised features, and the calibration of the score."""

    def __init__(self, good: np.ndarray, unlabelled: np.ndarray, prior: float, bad: np.ndarray | None = None, epochs: int = 30):
        self.prior = prior
        mixed = np.concatenate([good, unlabelled])
        self.mean, self.scale = mixed.mean(axis=0, dtype=np.float64).astype(np.float32), (mixed.std(axis=0, dtype=np.float64) + 0.02).astype(np.float32)
        mixed -= self.mean  # in place: the driver holds one copy of the sample
        mixed /= self.scale
        np.clip(mixed, -8, 8, out=mixed)
        n_good = len(good)

        def gradient(w: np.ndarray, i: np.ndarray) -> np.ndarray:
            i_p, i_u = i[i < n_good], i[i >= n_good]
            if not len(i_p) or not len(i_u):
                return np.zeros_like(w)
            x_p, x_u = mixed[i_p], mixed[i_u]
            z_p, z_u = x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1]
            part = lambda x, r: np.append(x.T @ r / len(r), r.mean())
            up = prior * part(x_p, -sigmoid(-z_p))
            down = part(x_u, sigmoid(z_u)) - prior * part(x_p, sigmoid(z_p))
            risk = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
            return (up + down if risk >= 0 else -down) + np.append(1e-4 * w[:-1], 0)

        self.w = adam(gradient, len(mixed), mixed.shape[1] + 1, epochs, 0.02, batch=512)
        self.slope, self.shift = 1.0, 0.0
        if bad is not None and len(bad) >= 20:
            z = np.concatenate([self.margin(good), self.margin(bad)])
            # Both samples are weighted to their shares by the shift of the intercept.
            self.slope, self.shift = platt(z, np.r_[np.ones(len(good)), np.zeros(len(bad))])
            self.shift += np.log(prior / (1 - prior)) - np.log(len(good) / len(bad))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.w[:-1] + self.w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH, prior: float | None = None) -> Model | None:
    """Fit on docs (doc_id, text) and labels (doc_id, quality: 1 or 0; documents without one are unlabelled), about each
    rows of each kind at most.

    The prior is the share of 1 among the labelled rows unless given. Bad rows serve the prior and the calibration of the
    score alone, not the risk. None if there is no trusted or no unlabelled row; a null or empty text is a row like any other.
    """
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = docs.select("doc_id").join(given, "doc_id", "left")
    rows = sample(docs, known, "quality", each, dense(features))
    parts = {k: undense([r for r in rows if r[0] == k], WIDTH) for k in (1, 0, None)}
    if not len(parts[1]) or not len(parts[None]):
        return None
    if prior is None:
        r = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        prior = min(0.98, max(0.02, r))
    return Model(parts[1], parts[None], prior, parts[0])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) for each row, from text alone; every other column is left out.

    A null text is an empty one, and its score is what the model gives for no text; without a model every score is 0.5. Texts are read
    whole. Rows given twice get the same score; an empty table gives an empty table.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                x = features(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    return short_batches(docs).select("doc_id", "text").mapInArrow(told, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = F.pmod(crc(), F.lit(4)) != 2
    out = scored(docs, fit(docs.where(seen), labels.where(seen)))
    return out.select("doc_id", (F.pmod(crc(), F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
