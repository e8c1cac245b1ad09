"""Toxicity categories with a chain of linear classifiers.

The categories are predicted one after the other; a later model also sees the probabilities of the earlier ones. What it sees in
training are out-of-fold predictions: the earlier model is fitted anew without a fold to predict it, so that the
later one meets probabilities as uncertain as they will be. Features are the presence and share of words, and of beginnings of words, that tell toxic texts from others.

The labels table marks `toxic` alone. Two finer categories come before it in the chain: a toxic text is also an `insult` or
a `degradation` if it holds a word of that list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, table, word_hashes
from lodestone.llm.linear import crc, logistic, sample, sigmoid

#: Rows of each label that a fit uses, at most (about), and the words that it picks as features.
EACH, VOCABULARY, FOLDS = 2000, 300, 5
#: Bytes of a word's beginning that are features too, so that inflected and compound forms count.
PREFIXES = (4, 5, 6, 7, 8)
LEXICON = {
    "insult": "idiot moron stupid clown loser fool dumb".split(),
    "degradation": "trash scum worthless pathetic disgusting vermin filth".split(),
}


def hashes(text: str | None) -> np.ndarray:
    return word_hashes(text, PREFIXES)


def word_sets(texts: list[str | None]) -> list[bytes]:
    return [np.unique(hashes(t)).tobytes() for t in texts]


class Model:
    def __init__(self, sets: list[np.ndarray], labels: dict[str, np.ndarray], vocabulary: int = VOCABULARY, folds: int = FOLDS):
        self.categories = list(labels)
        last = labels[self.categories[-1]]
        flat = np.concatenate(sets)
        of = np.repeat(last, [len(s) for s in sets])
        words, place = np.unique(flat, return_inverse=True)
        inside = np.bincount(place, weights=of, minlength=len(words))
        outside = np.bincount(place, weights=1 - of, minlength=len(words))
        # Words by their log-odds, at least as certain as a count of five allows.
        p, q = (inside + 0.5) / (last.sum() + 1), (outside + 0.5) / (len(last) - last.sum() + 1)
        strength = np.where(inside + outside >= 5, np.log(p / q) * np.sqrt(p), -np.inf)
        best = np.argsort(-strength, kind="stable")[: min(vocabulary, int((strength > 0).sum()))]
        self.words = np.sort(words[best])
        x = np.stack([self.present(s) for s in sets])
        fold = np.arange(len(x)) % folds
        self.weights, earlier = [], np.zeros((len(x), 0))
        for name in self.categories:
            y = labels[name].astype(float)
            full = np.c_[x, earlier]
            weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
            held = np.zeros(len(x))
            for k in range(folds):
                i = fold != k
                w = logistic(full[i], y[i], weight[i], l2=1e-4, rate=0.1, epochs=20)
                held[~i] = sigmoid(full[~i] @ w[:-1] + w[-1])
            self.weights.append(logistic(full, y, weight, l2=1e-4, rate=0.1, epochs=20))
            earlier = np.c_[earlier, held]

    def present(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words) + 1)
        if len(hashes) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            out[at[hit]] = 1.0
            out[-1] = min(1.0, 10.0 * hit.sum() / len(hashes))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            full = np.c_[x, out]
            out = np.c_[out, sigmoid(full @ w[:-1] + w[-1])]
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, list[str]] | None = None, each: int = EACH) -> Model | None:
    """Fit on docs (doc_id, text) and labels (doc_id, toxic: 1 or 0), about each rows of each label at most.

    None if one of the labels is missing altogether.
    """
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = sample(docs, docs.select("doc_id").join(given, "doc_id"), "toxic", each, word_sets)
    y = np.array([int(v) for v, _ in rows])
    if not len(y) or y.min() == y.max():
        return None
    sets = [np.frombuffer(x, np.uint64) for _, x in rows]
    labels = {}
    for name, listed in (LEXICON if categories is None else categories).items():
        own = np.array([word_hashes(w)[0] for w in listed], np.uint64)
        labels[name] = np.array([int(t == 1 and np.isin(own, s).any()) for t, s in zip(y, sets, strict=True)])
    return Model(sets, labels | {"toxic": y})


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and p_<category> for each category, toxic last, for each row, from text alone; every other column is left out.

    A null or empty text has no words and gets what the model says of that; without a model all are 0. Texts are read whole.
    Rows given twice get the same answer; an empty table gives an empty table.
    """
    names = model.categories if model else [*LEXICON, "toxic"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = part["text"].to_pylist()
                p = model.predict(np.stack([model.present(hashes(t)) for t in texts])) if model else np.zeros((len(texts), len(names)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(x) for x in p.T)], ["doc_id", *(f"p_{n}" for n in names)])

    return short_batches(docs).select("doc_id", "text").mapInArrow(told, f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'p_{n} double' for n in names)}")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = F.pmod(crc(), F.lit(4)) != 2
    out = scored(docs, fit(docs.where(seen), labels.where(seen)))
    return out.select("*", (F.pmod(crc(), F.lit(4)) == 2).alias("held_out"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
