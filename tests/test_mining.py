"""Mining against a brute-force search over all sets of items."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import binning, mining
from lodestone.sources.frames import frame


def entropy(v):
    n = sum(v)
    return -sum(c / n * math.log(c / n) for c in v if c) if n else 0.0


def brute(fit, top, depth, least):
    """Every set of items from different columns, with support, utility and gain; prefixes have to pass as well."""
    data = [(r, r["n"]) for r in fit.rows.collect()]
    order = sorted(fit.items, key=lambda i: (i.twu, i.id))
    floor = sorted((i.riu for i in fit.items), reverse=True)[min(top, len(fit.items)) - 1]
    cover = lambda p: frozenset(k for k, (r, _) in enumerate(data) if all(r[f"code_{i.col}"] == i.code for i in p))
    counts = lambda rows: [sum(n for k, (r, n) in enumerate(data) if k in rows and r["label"] == c) for c in fit.classes]

    def gain(rows, base):
        inside, whole = counts(rows), counts(base)
        rest = [w - i for w, i in zip(whole, inside)]
        n = sum(whole)
        return None if not sum(inside) or not sum(rest) else entropy(whole) - sum(inside) / n * entropy(inside) - sum(rest) / n * entropy(rest)

    everything = frozenset(range(len(data)))
    out = [((i,), i.support, i.riu, gain(cover((i,)), everything)) for i in fit.items]
    out = [x for x in out if x[2] >= floor and x[3] is not None and x[3] > least]
    usable = [i for i in order if i.gain is not None and i.gain > least and i.twu >= floor]
    alive = [(i,) for i in usable]
    for size in range(2, depth + 1):
        grown = []
        for p in alive:
            seen = set()
            for y in usable[usable.index(p[-1]) + 1 :]:
                if y.col in {i.col for i in p}:
                    continue
                rows = cover((*p, y))
                g = gain(rows, cover(p[: size - 2]) if size > 2 else everything)
                if g is None or g <= least or rows in seen:
                    continue
                seen.add(rows)
                grown.append((*p, y))
                support = sum(data[k][1] for k in rows)
                u = round(support * sum(i.iu for i in (*p, y)), 9)
                if u >= floor:
                    out.append(((*p, y), support, u, g))
        alive = grown
    best = sorted(out, key=lambda x: (-x[2], -x[0][0].twu, tuple(-i.id for i in x[0])))[:top]
    if depth > 1:
        kept, seen = [], set()
        for x in sorted(best, key=lambda x: (-round(x[3], 9), -x[2], tuple(i.id for i in x[0]))):
            if cover(x[0]) not in seen:
                seen.add(cover(x[0]))
                kept.append(x)
        best = kept
    return sorted((tuple(i.id for i in p), s, round(u, 6), round(g, 6)) for p, s, u, g in best)


@pytest.mark.parametrize(("name", "depth", "top", "least"), [("score_hi", 1, 6, 1e-3), ("score_hi", 2, 15, 1e-3), ("score_hi", 3, 40, 1e-4), ("xor2", 3, 40, 1e-6), ("multi3", 2, 20, 1e-3), ("missing", 3, 30, 1e-4)])
def test_patterns_are_those_of_an_exhaustive_search(spark, sf, name, depth, top, least):
    df = frame(spark, sf, name)
    fit = mining.prepare(df, binning.fit_fixed(df, ["l_quantity", "l_discount", "l_tax"], 3))
    got = sorted((tuple(i.id for i in p.items), p.support, round(p.utility, 6), round(p.ig, 6)) for p in mining.mine(fit, top, depth, least))
    assert got == brute(fit, top, depth, least)


def test_categories_missing_values_and_one_class(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 1), ("b", None, 0), (None, float("nan"), 0), ("b", 4.0, 0), ("c", float("inf"), 1)]
    df = spark.createDataFrame(rows, "c string, x double, label int")
    bins = binning.fit_fixed(df, ["c", "x"], 3)
    assert bins[0].levels == ["a", "b", "c"]
    fit = mining.prepare(df, bins)
    assert sum(i.support for i in fit.items if i.col == "x") <= 3
    same = df.withColumn("label", F.lit(1))
    assert mining.mine(mining.prepare(same, bins), 5, 2, 1e-3) == []


def test_codes_clamp_and_follow_inner_edges(spark):
    b = binning.ColumnBins("x", "adaptive", [0.0, 1.0, 2.0, 3.0])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in (-9.0, 0.0, 0.99, 1.0, 2.5, 3.0, 99.0, None)], "x double").select(b.code()).collect()]
    assert got == [0, 0, 0, 1, 2, 2, 2, None]


def test_elbow_stops_at_the_first_small_step():
    assert binning.elbow({2: 0.1, 3: 0.2, 5: 0.2001, 7: 0.5, 10: 0.6, 15: 0.7}, 100) == 3
    assert binning.elbow({2: 0.0, 3: 0.0, 5: 0.1, 7: 0.2, 10: 0.2, 15: 0.9}, 100) == 7
    assert binning.elbow({}, 9) == 7


def test_fallback_keeps_a_record(spark, sf):
    df = frame(spark, sf, "null_signal")
    found, log = mining.mine_with_fallback(mining.prepare(df, binning.fit_fixed(df, ["l_quantity", "l_discount"], 3)), 20, 2, 0.05)
    assert found and len(log) == 4 and log[0]["patterns"] == 0
