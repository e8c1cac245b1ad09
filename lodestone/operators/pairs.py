"""Interactions of two columns: their information, derived features, redundancy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.information import entropy_bits, finite, gain_bits
from lodestone.operators.quantiles import percentiles

OPERATIONS = {"product": lambda a, b: a * b, "absdiff": lambda a, b: F.abs(a - b), "sum": lambda a, b: a + b, "diff": lambda a, b: a - b}


def quartile_codes(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Four quantile codes of each column; of at most four distinct values the dense code; null where missing."""
    r = df.agg(*(F.count_distinct(finite(c)).alias(f"n_{c}") for c in columns)).first()
    q = percentiles(df, {c: finite(c) for c in columns}, (0.25, 0.5, 0.75))
    few = [c for c in columns if r[f"n_{c}"] <= 4]
    levels = df.agg(*(F.sort_array(F.collect_set(finite(c))).alias(c) for c in few)).first() if few else {}
    out = {}
    for c in columns:
        cuts = levels[c][1:] if c in few else sorted(set(q[c] or []))
        out[c] = F.when(finite(c).isNotNull(), sum((F.when(finite(c) >= v, 1).otherwise(0) for v in cuts), F.lit(0)))
    return out


def interaction_information(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """a, b, ig_a, ig_b, ig_ab and ii = ig_ab - ig_a - ig_b of each pair, on rows where both are there: one histogram of all pairs."""
    codes = quartile_codes(df, columns)
    coded = df.select(F.col(label).alias("y"), *(v.alias(c) for c, v in codes.items())).groupBy("y", *columns).agg(F.count("*").alias("n"))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("z")) for a, b in combinations(columns, 2)))
    rows = coded.select("y", "n", F.explode(cells).alias("c")).where("c.x is not null and c.z is not null").groupBy("c.a", "c.b", "c.x", "c.z", "y").agg(F.sum("n").alias("n")).collect()
    labels = sorted({r["y"] for r in rows})
    hist: dict[tuple[str, str], dict[tuple[int, int], list[int]]] = {}
    for r in rows:
        hist.setdefault((r["a"], r["b"]), {}).setdefault((r["x"], r["z"]), [0] * len(labels))[labels.index(r["y"])] += r["n"]
    out = []
    for (a, b), cells_ in hist.items():
        side = lambda k, cells_=cells_: gain_bits([[sum(v[j] for c, v in cells_.items() if c[k] == x) for j in range(len(labels))] for x in {c[k] for c in cells_}], 1e-15)
        ga, gb, gab = side(0), side(1), gain_bits(list(cells_.values()), 1e-15)
        out.append((a, b, round(ga, 6), round(gb, 6), round(gab, 6), round(gab - ga - gb, 6)))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: (-r[5], r[0], r[1])), "a string, b string, ig_a double, ig_b double, ig_ab double, ii double")


def pair_scores(df: DataFrame, pairs: Sequence[tuple[str, str]], label: str = "label", top: int = 20, buckets: Sequence[int] = tuple(range(2, 13))) -> DataFrame:
    """feature, ig of derived columns: the best gain in bits over 2 to 12 quantiles of their distinct values. One pass makes all of them."""
    derived = [(f"{a} {k} {b}", f(finite(a), finite(b))) for a, b in pairs for k, f in OPERATIONS.items()]
    cells = F.array(*(F.struct(F.lit(k).alias("f"), F.round(v, 9).alias("x")) for k, v in derived))
    counts = df.select(F.col(label).alias("y"), F.explode(cells).alias("c")).where("c.x is not null").groupBy("c.f", "c.x", "y").agg(F.count("*").alias("n")).persist()
    q = counts.select("f", "x").distinct().groupBy("f").agg(*(F.percentile("x", F.array(*(F.lit(i / b) for i in range(1, b)))).alias(f"q{b}") for b in buckets))
    tried = counts.join(F.broadcast(q), "f")  # a row for each derived column
    code = F.array(*(F.struct(F.lit(b).alias("b"), F.size(F.filter(F.array_distinct(f"q{b}"), lambda e: F.col("x") >= e)).alias("k")) for b in buckets))
    h = tried.select("f", "y", "n", F.explode(code).alias("c")).groupBy("f", "c.b", "c.k", "y").agg(F.sum("n").alias("n")).collect()
    labels = sorted({r["y"] for r in h})
    hist: dict = {}
    for r in h:
        hist.setdefault(r["f"], {}).setdefault(r["b"], {}).setdefault(r["k"], [0] * len(labels))[labels.index(r["y"])] += r["n"]
    best = [(f, round(max(gain_bits(list(v.values()), 1e-15) for v in by.values()), 6)) for f, by in hist.items()]
    return df.sparkSession.createDataFrame(sorted(best, key=lambda r: (-r[1], r[0]))[:top], "feature string, ig double")


def pair_features(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Columns `a op b`, standardised by mean and root mean square around it; where a side is missing, the mean, so 0."""
    made = {f"{a} {k} {b}": OPERATIONS[k](finite(a), finite(b)) for a, k, b in pairs}
    r = df.agg(*(f(v).alias(f"{n}{i}") for i, v in enumerate(made.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return df.select("*", *((F.coalesce((v - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0), F.lit(0.0))).alias(k) for i, (k, v) in enumerate(made.items())))


def redundant(df: DataFrame, columns: Sequence[str], vif: float = 5.0, r2: float = 0.8) -> dict[str, str]:
    """Columns to drop and why: constant, duplicate or complement of an earlier one, or explained by earlier ones. From one aggregation of moments."""
    import numpy as np

    k = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    moments = df.agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
    n, mean = moments["n"], np.array([moments[f"s{i}"] / moments["n"] for i in range(k)])
    cov = np.array([[moments[f"g{min(i, j)}_{max(i, j)}"] / n - mean[i] * mean[j] for j in range(k)] for i in range(k)])
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    out: dict[str, str] = {}
    kept: list[int] = []
    for i, c in enumerate(columns):
        if sd[i] < 1e-12:
            out[c] = "constant"
            continue
        r = [cov[i, j] / (sd[i] * sd[j]) for j in kept]
        if any(abs(v) > 1 - 1e-9 for v in r):
            out[c] = "duplicate" if max(r) > 1 - 1e-9 else "complement"
            continue
        if kept:
            inner = cov[np.ix_(kept, kept)] / np.outer(sd[kept], sd[kept])
            share = float(np.array(r) @ np.linalg.pinv(inner) @ np.array(r))
            if share >= r2 and 1 / max(1e-12, 1 - share) > vif:
                out[c] = "explained"
                continue
        kept.append(i)
    return out


def label_entropy(df: DataFrame, label: str = "label") -> float:
    return entropy_bits([r[1] for r in df.groupBy(label).count().collect()], 0.0 or 1e-300)


def chi2_critical_gain(n: int, alpha: float, tests: int) -> float:
    """The gain in bits that a split of n rows has to reach at level alpha with that many tests, one degree of freedom (Bonferroni)."""
    p, lo, hi = alpha / max(1, tests), 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > p else (lo, mid)
    return hi / (2 * n * math.log(2))
