"""Grids of settings that share what they have in common, and resampling for imbalance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import binning, metrics, mining, models

#: Named grids; `bins` 0 stands for adaptive bins.
GRIDS = {
    "fast": {"bins": [0], "top": [50], "length": [1], "least_gain": [1e-3]},
    "standard": {"bins": [0], "top": [50, 100], "length": [1, 2], "least_gain": [1e-4, 1e-3]},
    "interactions": {"bins": [0], "top": [100], "length": [2, 3], "least_gain": [1e-4]},
    "fixed": {"bins": [3, 5, 7], "top": [50], "length": [1, 2], "least_gain": [1e-3]},
}
_VARY = ("bins", "top", "length", "least_gain", "c")


def expand(grid: dict[str, Sequence]) -> list[dict]:
    """All combinations, in order, checked."""
    unknown = set(grid) - set(_VARY)
    if unknown:
        raise ValueError(f"can't vary {sorted(unknown)}; {list(_VARY)} can")
    full = {"bins": [0], "top": [50], "length": [1], "least_gain": [1e-3], "c": [1.0]} | {k: list(v) for k, v in grid.items()}
    if any(t < 1 for t in full["top"]) or any(n < 1 for n in full["length"]) or any(b != 0 and not 2 <= b <= 100 for b in full["bins"]):
        raise ValueError("top and length start at 1; bins are 0 (adaptive) or 2 to 100")
    return [dict(zip(full, v, strict=True)) for v in product(*full.values())]


@dataclass
class Tuned:
    best: dict
    score: float
    fit: mining.Fit
    results: list[dict] = field(default_factory=list)


def tune(df: DataFrame, columns: Sequence[str], grid: dict[str, Sequence] | str = "fast", key: str | None = None, folds: int = 3, label: str = "label") -> Tuned:
    """The settings with the best mean AUC over folds. Edges and transactions are made once for each fold and number of bins, and
    mined once for each (top, length, least_gain) on them, whatever else varies.
    """
    settings = expand(GRIDS[grid] if isinstance(grid, str) else grid)
    fold = F.pmod(F.xxhash64(*([key] if key else [*columns, label]), F.lit(3)), F.lit(folds))
    data = df.withColumn("_fold", fold).persist()
    totals: dict[int, list[float]] = {k: [] for k in range(len(settings))}
    for k in range(folds):
        train, test = data.where(F.col("_fold") != k), data.where(F.col("_fold") == k)
        prepared: dict[int, mining.Fit] = {}
        scores: dict[tuple, float] = {}
        for n, s in enumerate(settings):
            if s["bins"] not in prepared:
                prepared[s["bins"]] = mining.prepare(train, _bins(train, columns, s["bins"], label), label)
            same = tuple(s[v] for v in _VARY)
            if same not in scores:
                fit = prepared[s["bins"]]
                mining.mine(fit, s["top"], s["length"], s["least_gain"])
                scores[same] = evaluate(fit, train, test, s["c"], label)
            totals[n].append(scores[same])
        for fit in prepared.values():
            fit.rows.unpersist()
    data.unpersist()
    results = [s | {"auc": round(sum(totals[n]) / folds, 6)} for n, s in enumerate(settings)]
    best = max(range(len(results)), key=lambda n: (results[n]["auc"], -n))
    s = settings[best]
    fit = mining.prepare(df, _bins(df, columns, s["bins"], label), label)
    mining.mine(fit, s["top"], s["length"], s["least_gain"])
    return Tuned(s, results[best]["auc"], fit, results)


def _bins(df: DataFrame, columns: Sequence[str], bins: int, label: str) -> list[binning.ColumnBins]:
    return binning.fit_fixed(df, columns, bins) if bins else binning.fit_adaptive(df, columns, label=label)


def evaluate(fit: mining.Fit, train: DataFrame, test: DataFrame, c: float, label: str) -> float:
    if not fit.patterns:
        return 0.5
    names = [f"p{k}" for k in range(len(fit.patterns))]
    out = models.with_probability(mining.pattern_columns(train, fit), mining.pattern_columns(test, fit), label, "_p", names, c=c)
    return metrics.auc(out, label, "_p").first()["auc"] or 0.5


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: rows / (classes * rows of the class)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    w = F.lit(None).cast("double")
    for k, v in counts.items():
        w = F.when(F.col(label) == k, n / (len(counts) * v)).otherwise(w)
    return df.withColumn("weight", w)


def resample(df: DataFrame, key: str, label: str = "label", how: str = "under", seed: int = 0) -> DataFrame:
    """Classes of about equal size: rows of the larger ones are left out by a hash of the key, or those of the smaller ones repeated."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    size = min(counts.values()) if how == "under" else max(counts.values())
    copies = F.lit(0)
    for k, v in counts.items():
        share = size / v
        copies = F.when(F.col(label) == k, int(share) + (u < share - int(share)).cast("int")).otherwise(copies)
    return df.withColumn("_n", copies).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_k")
