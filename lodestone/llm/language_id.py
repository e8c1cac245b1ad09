"""Language identification in two levels: the family first, then the languages within it.

Features are hashed byte trigrams of the lower-cased whole text without digits and punctuation. The family comes from one-versus-rest linear
models; within a family, a linear support vector machine for each pair of languages votes, and margins break ties.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, table
from lodestone.llm.linear import crc, dense, logistic, sample, sigmoid, svm, undense

WIDTH = 4096
#: Rows of each language that the models are fitted on, at most (about).
EACH = 500
#: Families of common languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi ur bn mr gu pa ne",
}


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang.split("-")[0] in v.split()), lang)


_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of square roots of trigram shares for each text, of length 1, or zero."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        b = _KEEP[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "replace"), np.uint8)]
        b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]].astype(np.uint32)
        if len(b) >= 3:
            h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 12)
            n = np.bincount(h, minlength=WIDTH)
            row[:] = np.sqrt(n / n.sum())
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """Families and their languages, and the weights of both levels as matrices."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        of = np.array([family(v) for v in langs])
        self.top = None
        if len(self.families) > 1:
            self.top = np.stack([logistic(x, (of == f).astype(float), l2=1e-5, epochs=25, rate=0.2) for f in self.families])
        self.pairs = [(a, b) for f in self.families for a, b in itertools.combinations([v for v in self.langs if family(v) == f], 2)]
        self.inner = np.zeros((len(self.pairs), x.shape[1] + 1))
        for k, (a, b) in enumerate(self.pairs):
            i = np.flatnonzero((names == a) | (names == b))
            self.inner[k] = svm(x[i], np.where(names[i] == a, 1.0, -1.0), l2=1e-5, epochs=25, rate=0.2)
        self.top = None if self.top is None else self.top.astype(np.float32)
        self.inner = self.inner.astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        share = np.ones((len(x), len(self.families)))
        if self.top is not None:
            share = sigmoid(x @ self.top[:, :-1].T + self.top[:, -1]) + 1e-12
            share /= share.sum(axis=1, keepdims=True)
        votes = np.zeros((len(x), len(self.langs)))
        margin = x @ self.inner[:, :-1].T + self.inner[:, -1]
        at = {v: k for k, v in enumerate(self.langs)}
        for k, (a, b) in enumerate(self.pairs):
            p = sigmoid(4.0 * margin[:, k])
            votes[:, at[a]] += (margin[:, k] >= 0) + 1e-3 * p
            votes[:, at[b]] += (margin[:, k] < 0) + 1e-3 * (1 - p)
        best = share.argmax(axis=1)
        mine = np.array([[self.families.index(family(v)) for v in self.langs]]) == best[:, None]
        choice = np.where(mine, votes, -1.0).argmax(axis=1)
        score = share[np.arange(len(x)), best]
        inner = np.ones(len(x))
        for k, (a, b) in enumerate(self.pairs):
            p = sigmoid(4.0 * margin[:, k])
            inner = np.where(choice == at[a], np.minimum(inner, p), np.where(choice == at[b], np.minimum(inner, 1 - p), inner))
        return [self.langs[k] for k in choice], np.clip(score * inner, 0.0, 1.0)


def fit(docs: DataFrame, each: int = EACH) -> Model | None:
    """Fit on about each rows of every lang at most, of rows whose text and lang aren't null; None if there are none."""
    known = docs.where("lang is not null and text is not null")
    rows = sample(known, known.select("doc_id", "lang"), "lang", each, dense(features))
    return Model(undense(rows, WIDTH), [v for v, _ in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score for each row, from text alone; every other column is left out.

    A text that is null, empty or has no letter is `und` with score 0, and so is every text if there is no model. Texts are read
    whole, however long. Rows given twice get the same answer twice; an empty table gives an empty table.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = part["text"].to_pylist()
                good = [has_letter(t) and model is not None for t in texts]
                langs, scores = model.predict(features(texts)) if model is not None else ([""] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([v if g else "und" for v, g in zip(langs, good, strict=True)]), pa.array(np.where(good, scores, 0.0))], ["doc_id", "lang_pred", "score"])

    return short_batches(docs).select("doc_id", "text").mapInArrow(told, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with a score of at least `least`. Texts aren't shuffled.

    Texts that are `und` go, and without a model every text is.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = part["text"].to_pylist()
                scores = model.predict(features(texts))[1] if model is not None else np.zeros(len(texts))
                yield part.filter(pa.array([has_letter(t) and s >= least and model is not None for t, s in zip(texts, scores, strict=True)], pa.bool_()))

    return short_batches(docs).mapInArrow(kept, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.pmod(crc(), F.lit(3)) != 1))
    return identify(docs, model).select("doc_id", (F.pmod(crc(), F.lit(3)) == 1).alias("held_out"), "lang_pred", "score")
