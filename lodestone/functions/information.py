"""Entropy, information gain and correlation, on columns and on small count tables.

Three logarithms occur, and they aren't exchangeable: mining uses the natural one, adaptive binning log2(p + 1e-12), feature scores log2(p + 1e-15).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(counts: Sequence[float]) -> float:
    """In natural units, of counts of classes."""
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts if c > 0) if n else 0.0


def entropy_bits(counts: Sequence[float], eps: float = 1e-12) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n + eps) for c in counts) if n else 0.0


def gain(inside: Sequence[float], total: Sequence[float]) -> float | None:
    """Information gain, in natural units, of rows inside against the rest; None if a side is empty."""
    outside = [t - i for t, i in zip(total, inside, strict=True)]
    n_in, n_out = sum(inside), sum(outside)
    if not n_in or not n_out:
        return None
    n = n_in + n_out
    return entropy(total) - n_in / n * entropy(inside) - n_out / n * entropy(outside)


def gain_bits(groups: Sequence[Sequence[float]], eps: float = 1e-12) -> float:
    """Information gain in bits of a partition into groups of class counts."""
    total = [sum(x) for x in zip(*groups, strict=True)]
    n = sum(total)
    return entropy_bits(total, eps) - sum(sum(g) / n * entropy_bits(g, eps) for g in groups) if n else 0.0


def pearson(pairs: Sequence[tuple[float, float, float]]) -> float:
    """Correlation of x and y from (x, y, weight); 0 where one is constant."""
    n = sum(w for *_, w in pairs)
    if not n:
        return 0.0
    mx, my = sum(x * w for x, _, w in pairs) / n, sum(y * w for _, y, w in pairs) / n
    sxy = sum((x - mx) * (y - my) * w for x, y, w in pairs)
    sxx, syy = sum((x - mx) ** 2 * w for x, _, w in pairs), sum((y - my) ** 2 * w for _, y, w in pairs)
    return sxy / math.sqrt(sxx * syy) if sxx > 1e-12 and syy > 1e-12 else 0.0


def normalised_information(inside: Sequence[float], total: Sequence[float]) -> float:
    """Mutual information of an indicator and the class, divided by the root of the product of both entropies, in [0, 1]."""
    n, k = sum(total), sum(inside)
    hx, hy = entropy([k, n - k]), entropy(total)
    g = gain(inside, total)
    return min(1.0, max(0.0, (g or 0.0) / math.sqrt(hx * hy))) if hx > 0 and hy > 0 else 0.0


def finite(column: str) -> Column:
    """The column as a double, null where it isn't a finite number: missing values are one thing from here on."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
