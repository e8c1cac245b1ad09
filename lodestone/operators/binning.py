"""Discretisation: quantile edges, bin codes, the number of bins.

A column's edges are linear percentiles without repeats; all columns share one aggregation. A code is the number of inner
edges at or below a value, so values beyond the outer edges fall into the outer bins; a missing value has no code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.information import finite, gain_bits
from lodestone.operators.quantiles import percentiles

CANDIDATES = (2, 3, 5, 7, 10, 15)
MIN_GAIN = 0.02


@dataclass
class ColumnBins:
    """How one column becomes codes. kind: float, int, cat or adaptive."""

    name: str
    kind: str
    edges: list[float] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    low: float = 0.0
    span: float = 1.0

    @property
    def size(self) -> int:
        return len(self.levels) if self.kind == "cat" else max(1, len(self.edges) - 1)

    def code(self) -> Column:
        if self.kind == "cat":
            out = F.lit(None).cast("int")
            for k, v in enumerate(self.levels):
                out = F.when(F.col(self.name).cast("string") == v, k).otherwise(out)
            return out
        x = finite(self.name)
        x = (x - self.low) / self.span if self.kind == "float" else x
        return F.when(x.isNotNull(), sum((F.when(x >= e, 1).otherwise(0) for e in self.edges[1:-1]), F.lit(0)))

    def label(self, k: int) -> str:
        if self.kind == "cat":
            return f"{self.name}={self.levels[k]}"
        lo, hi = (self.low + self.span * e if self.kind == "float" else e for e in self.edges[k : k + 2])
        return f"{self.name}=[{int(lo)},{int(hi)}]" if self.kind == "int" else f"{self.name}=[{lo:.4g},{hi:.4g})"


def kind_of(df: DataFrame, column: str) -> str:
    t = dict(df.dtypes)[column]
    return "int" if t in ("tinyint", "smallint", "int", "bigint", "boolean") else "float" if t in ("float", "double") or t.startswith("decimal") else "cat"


def unique_edges(edges: Sequence[float]) -> list[float]:
    out = sorted(set(edges))
    return out if len(out) > 1 else [out[0], out[0] + 1e-9] if out else [0.0, 1e-9]


def fit_fixed(df: DataFrame, columns: Sequence[str], bins: int = 5, exact: bool = True) -> list[ColumnBins]:
    """Edges for all columns in two aggregations: extremes and distinct counts, then percentiles.

    exact=False takes approximate percentiles, whose memory doesn't grow with the number of distinct values.
    """
    kinds = {c: kind_of(df, c) for c in columns}
    numeric = [c for c in columns if kinds[c] != "cat"]
    out: dict[str, ColumnBins] = {}
    if numeric:
        x = {c: finite(c) for c in numeric}
        r = df.agg(*(f(x[c]).alias(f"{k}_{c}") for c in numeric for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count_distinct)))).first()
        scale = {c: ((r[f"lo_{c}"] or 0.0, (r[f"hi_{c}"] or 0.0) - (r[f"lo_{c}"] or 0.0) or 1.0) if kinds[c] == "float" else (0.0, 1.0)) for c in numeric}
        size = {c: max(min(r[f"n_{c}"] - 1, bins), 2) for c in numeric}
        at = lambda c: [k / size[c] for k in range(size[c] + 1)]
        scaled = {c: (x[c] - scale[c][0]) / scale[c][1] for c in numeric}
        q = percentiles(df, scaled, {c: at(c) for c in numeric}) if exact else df.agg(*(F.percentile_approx(scaled[c], at(c), 10000).alias(c) for c in numeric)).first()
        out |= {c: ColumnBins(c, kinds[c], unique_edges(q[c] or []), [], *scale[c]) for c in numeric}
    cats = [c for c in columns if kinds[c] == "cat"]
    if cats:
        r = df.agg(*(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cats)).first()
        out |= {c: ColumnBins(c, "cat", [], list(r[c])) for c in cats}
    return [out[c] for c in columns]


def value_counts(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(col, x, label, n): what every candidate number of bins is scored from, in one pass over the rows."""
    long = df.select(F.col(label).cast("int").alias("label"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), finite(c).alias("x")) for c in columns))).alias("v"))
    return long.where("v.x is not null").groupBy("v.col", "v.x", "label").agg(F.count("*").alias("n"))


def scoring_edges(df: DataFrame, columns: Sequence[str], candidates: Sequence[int] = CANDIDATES, label: str = "label") -> dict[str, dict[int, list[float]]]:
    """Values at the rounded (half to even) ranks i / B * (n - 1), without repeats, for each candidate B.

    Ranks come from cumulative counts of distinct values, so rows aren't sorted; a column's distinct values are what one task orders.
    """
    counts = value_counts(df, columns, label).groupBy("col", "x").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("col").orderBy("x")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy("col"))
    ranked = counts.select("col", "x", (upto - F.col("n")).alias("first"), upto.alias("next"), total.alias("total"))
    places = F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in candidates for i in range(b + 1))))
    at = ranked.select("*", places.alias("p")).withColumn("rank", F.bround(F.col("p.i") / F.col("p.b") * (F.col("total") - 1), 0))
    out: dict[str, dict[int, list[float]]] = {}
    for r in at.where("rank >= first and rank < next").select("col", "p.b", "x").distinct().collect():
        out.setdefault(r[0], {}).setdefault(r[1], []).append(r[2])
    return {c: {b: sorted(set(v)) for b, v in by.items()} for c, by in out.items()}


def gains_by_bins(df: DataFrame, columns: Sequence[str], candidates: Sequence[int] = CANDIDATES, label: str = "label") -> tuple[dict[str, dict[int, float]], dict[str, int]]:
    """Information gain in bits of each candidate number of bins, for all columns, and the number of finite rows of each column."""
    edges = scoring_edges(df, columns, candidates, label)
    counts = value_counts(df, columns, label)
    code = F.lit(None).cast("int")
    for c, by in edges.items():
        for b, e in by.items():
            code = F.when((F.col("col") == c) & (F.col("b") == b), sum((F.when(F.col("x") >= v, 1).otherwise(0) for v in e[1:-1]), F.lit(0))).otherwise(code)
    tried = counts.select("*", F.explode(F.array(*map(F.lit, candidates))).alias("b"))
    rows = tried.select("col", "b", code.alias("code"), "label", "n").groupBy("col", "b", "code", "label").agg(F.sum("n").alias("n")).collect()
    labels = sorted({r["label"] for r in rows})
    hist: dict[str, dict[int, dict[int, list[float]]]] = {}
    for r in rows:
        hist.setdefault(r["col"], {}).setdefault(r["b"], {}).setdefault(r["code"], [0.0] * len(labels))[labels.index(r["label"])] += r["n"]
    finite_rows = {c: int(sum(sum(g) for g in by[candidates[0]].values())) for c, by in hist.items()}
    return {c: {b: gain_bits(list(by[b].values())) for b in candidates} for c, by in hist.items()}, finite_rows


def elbow(gains: dict[int, float], rows: int, candidates: Sequence[int] = CANDIDATES, min_gain: float = MIN_GAIN) -> int:
    """The last candidate before the relative gain falls below min_gain; the middle one for fewer than 10 rows."""
    if rows < 10:
        return candidates[len(candidates) // 2]
    chosen, previous = candidates[0], 0.0
    for b in sorted(candidates):
        g = gains[b]
        if previous > 0 and (g - previous) / (previous + 1e-9) < min_gain:
            break
        chosen, previous = b, g
    return chosen


def fit_adaptive(df: DataFrame, columns: Sequence[str], candidates: Sequence[int] = CANDIDATES, label: str = "label") -> list[ColumnBins]:
    """The number of bins by the elbow of the gain on rank edges; then percentile edges of that number, on raw values."""
    numeric = [c for c in columns if kind_of(df, c) != "cat"]
    gains, rows = gains_by_bins(df, numeric, candidates, label) if numeric else ({}, {})
    size = {c: elbow(gains[c], rows[c], candidates) if c in gains else candidates[len(candidates) // 2] for c in numeric}
    out = {b.name: b for b in fit_fixed(df, [c for c in columns if c not in numeric])}
    if numeric:
        q = percentiles(df, {c: finite(c) for c in numeric}, {c: [k / size[c] for k in range(size[c] + 1)] for c in numeric})
        out |= {c: ColumnBins(c, "adaptive", unique_edges(q[c] or [])) for c in numeric}
    return [out[c] for c in columns]


def apply_bins(df: DataFrame, bins: Sequence[ColumnBins], labels: bool = False) -> DataFrame:
    """df with code_<name>, or bin_<name> with the bins' labels; one projection."""
    if not labels:
        return df.select("*", *(b.code().alias(f"code_{b.name}") for b in bins))
    named = []
    for b in bins:
        code, text = b.code(), F.lit(None).cast("string")
        for k in range(b.size):
            text = F.when(code == k, b.label(k)).otherwise(text)
        named.append(text.alias(f"bin_{b.name}"))
    return df.select("*", *named)


def best_fixed(df: DataFrame, column: str, low: int = 2, high: int = 20, label: str = "label") -> int:
    """For bins=-1: the number of bins from low to high with the largest gain (in natural units; the smallest wins ties)."""
    gains, _ = gains_by_bins(df, [column], tuple(range(low, high + 1)), label)
    scale = math.log(2)
    return max(gains[column], key=lambda b: (round(gains[column][b] * scale, 12), -b))
