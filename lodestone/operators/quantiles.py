"""Exact percentiles found by counting rows in ranges, so that no task gathers the distinct values of a column."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that each interval is counted in by a pass; passes of ranges of one width, before every other one goes by roots.
RANGES, EVEN = 1024, 3


def percentiles(df: DataFrame, columns: Mapping[str, Column], at: Sequence[float] | Mapping[str, Sequence[float]]) -> dict[str, list[float] | None]:
    """For each name the linear percentiles of its column of finite numbers, nulls aside, as `percentile` gives them; None if there is no value.

    All columns share a pass over df. A pass counts the rows of ranges of values and their extremes, and the next one looks into those ranges alone that hold a rank asked
    for: two or three passes on most columns. What is shuffled and collected has at most RANGES rows for each percentile.
    """
    if not columns:
        return {}
    of = lambda c: at[c] if isinstance(at, Mapping) else at
    x = {c: v.cast("double") for c, v in columns.items()}
    r = df.agg(*(f(v) for v in x.values() for f in (F.count, F.min, F.max))).first()
    n, found, open_ = {}, {c: {} for c in x}, []
    for k, c in enumerate(x):
        n[c], lo, hi = r[3 * k : 3 * k + 3]
        if n[c]:
            ranks = {f((n[c] - 1) * p) for p in of(c) for f in (math.floor, math.ceil)}
            open_ += _narrowed(c, [(lo, hi, n[c])], 0, ranks, found[c])
    turn = 0
    while open_:
        cells = []
        for c, v in x.items():
            cell = F.lit(None).cast("struct<k: bigint, x: double>")
            for k, (name, lo, hi, _, _) in enumerate(open_):
                if name == c:
                    cell = F.when(v.between(lo, hi), F.struct((k * RANGES + _range(v, lo, hi, turn)).alias("k"), v.alias("x"))).otherwise(cell)
            if any(name == c for name, *_ in open_):
                cells.append(cell)
        rows = df.select(F.explode(F.array(*cells)).alias("v")).where("v is not null").groupBy("v.k").agg(F.min("v.x"), F.max("v.x"), F.count("*")).collect()
        inside: list[list] = [[] for _ in open_]
        for k, *cell in sorted(tuple(r) for r in rows):
            inside[k // RANGES].append(cell)
        open_ = [i for (c, _, _, before, ranks), by in zip(open_, inside, strict=True) for i in _narrowed(c, by, before, ranks, found[c])]
        turn += 1
    return {c: [_between(found[c], (n[c] - 1) * p) for p in of(c)] if n[c] else None for c in x}


def _range(x: Column, lo: float, hi: float, turn: int) -> Column:
    """The number of the range of lo to hi that x is in. Any function that doesn't fall will do: every other turn roots part what lies orders of magnitude apart."""
    root = lambda v: math.copysign(abs(v) ** (1 / 64), v)
    if turn >= EVEN and turn % 2 and root(hi) - root(lo) > 1e-9 * max(abs(root(lo)), abs(root(hi))):
        x, lo, hi = F.signum(x) * F.pow(F.abs(x), F.lit(1 / 64)), root(lo), root(hi)
    elif math.isinf(hi - lo):
        x, lo, hi = x / 2, lo / 2, hi / 2
    return F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * RANGES), F.lit(0)), F.lit(RANGES - 1))


def _narrowed(column: str, cells: Sequence[Sequence], before: int, ranks: set[int], found: dict[int, float]) -> list[tuple]:
    """The intervals (column, low, high, rows below, ranks) that hold ranks still open; of those that a cell's least or largest value has, the values are put into found."""
    out = []
    for lo, hi, k in cells:
        own = {r for r in ranks if before <= r < before + k}
        found.update({r: lo if r == before or lo == hi else hi for r in own if lo == hi or r in (before, before + k - 1)})
        if own := own - found.keys():
            out.append((column, lo, hi, before, own))
        before += k
    return out


def _between(found: dict[int, float], position: float) -> float:
    lower, higher = math.floor(position), math.ceil(position)
    if found[lower] == found[higher]:
        return found[lower]
    return (higher - position) * found[lower] + (position - lower) * found[higher]
