"""Top-K patterns of high utility behind an information-gain gate.

The rows are read once: they become weighted transactions, one for each combination of codes and label, by a partial
aggregation. Everything after that works on these, so mining costs what the combinations cost and not what the rows do. Pairs
and longer patterns are made inside a transaction from its ranked items, which needs neither a row key nor a self-join.
What comes to the driver are counts of items and of surviving patterns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.information import gain, normalised_information, pearson
from lodestone.operators.binning import ColumnBins, apply_bins

PATTERN = "pattern string, length int, support long, utility double, ig double"


@dataclass
class Item:
    id: int
    col: str
    code: int
    label: str
    iu: float
    counts: list[int]
    twu: float = 0.0
    gain: float | None = None
    rank: int = 0

    @property
    def support(self) -> int:
        return sum(self.counts)

    @property
    def riu(self) -> float:
        return round(self.support * self.iu, 9)


@dataclass
class Pattern:
    items: tuple[Item, ...]
    support: int
    utility: float
    ig: float
    cover: tuple = ()
    relaxed: bool = False

    @property
    def name(self) -> str:
        return " & ".join(i.label for i in self.items)


@dataclass
class Fit:
    """Weighted transactions with their items, and what mining needs of them."""

    rows: DataFrame
    bins: list[ColumnBins]
    items: list[Item]
    totals: list[int]
    classes: list[int]
    patterns: list[Pattern] = field(default_factory=list)


def transactions(df: DataFrame, bins: Sequence[ColumnBins], label: str = "label") -> DataFrame:
    """One row for each combination of codes and label, with the number n of rows that have it."""
    codes = [f"code_{b.name}" for b in bins]
    return apply_bins(df, bins).groupBy(*codes, F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))


def utilities(b: ColumnBins, hist: dict[int, list[int]], classes: list[int], missing: list[int]) -> dict[int, float]:
    """External times internal utility of each code: correlation times position of the bin, or normalised information for a category."""
    total = [sum(v[k] for v in hist.values()) for k in range(len(classes))]
    if b.kind == "cat":
        everything = [t + m for t, m in zip(total, missing, strict=True)]
        n, out = sum(everything), {}
        for code, counts in hist.items():
            cov = sum(c * y for c, y in zip(counts, classes, strict=True)) / n - sum(counts) / n * sum(c * y for c, y in zip(everything, classes, strict=True)) / n
            out[code] = normalised_information(counts, everything) * (1.0 if cov > 0 else 0.05)
        return out
    cells = [(code, y, c) for code, counts in hist.items() for y, c in zip(classes, counts, strict=True)]
    if b.kind == "adaptive":
        cells += [(0, y, c) for y, c in zip(classes, missing, strict=True)]
    r = pearson(cells)
    if b.kind == "adaptive":
        return {code: abs(r) / b.size for code in hist}
    top = max(b.edges)
    edge = (lambda k: b.edges[b.size - k]) if r < 0 else (lambda k: b.edges[k + 1])
    return {code: abs(r) * edge(code) / top if top else 0.0 for code in hist}


def prepare(df: DataFrame, bins: Sequence[ColumnBins], label: str = "label", boosts: dict[str, float] | None = None) -> Fit:
    """Transactions, items with utilities (largest 1, rounded to 6 places), supports and transaction-weighted utilities.

    boosts: a least correlation for columns whose interaction matters more than they do.
    """
    rows = transactions(df, bins, label).persist()
    cells = F.array(*(F.struct(F.lit(k).alias("col"), F.col(f"code_{b.name}").alias("code")) for k, b in enumerate(bins)))
    counted = rows.select("label", "n", F.explode(cells).alias("c")).groupBy("c.col", "c.code", "label").agg(F.sum("n").alias("n")).collect()
    classes = sorted({r["label"] for r in counted})
    hist: list[dict[int, list[int]]] = [{} for _ in bins]
    missing = [[0] * len(classes) for _ in bins]
    for r in counted:
        to = missing[r["col"]] if r["code"] is None else hist[r["col"]].setdefault(r["code"], [0] * len(classes))
        to[classes.index(r["label"])] += r["n"]
    totals = [sum(v[k] for v in hist[0].values()) + missing[0][k] for k in range(len(classes))] if bins else []
    raw = []
    for b, h, m in zip(bins, hist, missing, strict=True):
        u = utilities(b, h, classes, m)
        boost = (boosts or {}).get(b.name)
        if boost and b.kind != "cat":
            r = pearson([(code, y, c) for code, counts in h.items() for y, c in zip(classes, counts, strict=True)])
            u = {k: v * boost / abs(r) if r and boost > abs(r) else v for k, v in u.items()}
        raw += [(b, code, u[code], h[code]) for code in sorted(h) if u[code] > 0]
    top = max((x[2] for x in raw), default=1.0)
    items = [Item(k + 1, b.name, code, b.label(code), round(u / top, 6), counts) for k, (b, code, u, counts) in enumerate(raw)]
    for i in items:
        i.gain = gain(i.counts, totals)
    fit = Fit(rows, list(bins), items, totals, classes)
    if items:
        tu = F.aggregate(ranked(fit, items), F.lit(0.0), lambda a, x: a + x["iu"])
        twu = {r[0]: r[1] for r in rows.select("n", ranked(fit, items).alias("i"), tu.alias("tu")).select("n", "tu", F.explode("i").alias("x")).groupBy("x.id").agg(F.sum(F.col("n") * F.col("tu"))).collect()}
        for i in items:
            i.twu = round(twu.get(i.id, 0.0), 6)
    for k, i in enumerate(sorted(items, key=lambda i: (i.twu, i.id))):
        i.rank = k
    return fit


def ranked(fit: Fit, items: Sequence[Item]) -> Column:
    """The items of a transaction among the given ones as structs (rank, id, col, iu), by rank."""
    parts = []
    for k, b in enumerate(fit.bins):
        own = [i for i in items if i.col == b.name]
        x = F.lit(None).cast("struct<rank: int, id: int, col: int, iu: double>")
        for i in own:
            x = F.when(F.col(f"code_{b.name}") == i.code, F.struct(F.lit(i.rank).alias("rank"), F.lit(i.id).alias("id"), F.lit(k).alias("col"), F.lit(i.iu).alias("iu"))).otherwise(x)
        if own:
            parts.append(x)
    return F.array_sort(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<struct<rank: int, id: int, col: int, iu: double>>")


def seed(items: Sequence[Item], k: int) -> float:
    """The k-th largest support times utility, which a pattern has to reach."""
    r = sorted((i.riu for i in items), reverse=True)
    return r[min(k, len(r)) - 1] if r else 0.0


def budget(items: int, length: int, top: int) -> int:
    """top, or for -1 the number of possible patterns up to 20000."""
    if top != -1:
        return top
    from math import comb

    return min(20000, sum(comb(items, r) for r in range(1, 7)) if length < 1 else comb(items, length) if length > 1 else items) or 1


def mine(fit: Fit, top: int = 10, length: int = 1, least_gain: float = 1e-3, relaxed: Sequence[str] = ()) -> list[Pattern]:
    """Patterns of up to `length` items (0 or -1: any length), at most `top`.

    A singleton or pair is measured against all rows; a longer one against the rows of its prefix less two items. Items of one column don't
    combine. A pattern with the rows of an earlier one with the same prefix is dropped, then of patterns with the same rows the one with the
    largest gain stays. Items of `relaxed` columns pass the gates at the first two places, and pairs with one are kept by
    gain in a pool of their own; both pools are then cut by gain.
    """
    top = budget(len(fit.items), length, top)
    floor, deep = seed(fit.items, top), 99 if length < 1 else length
    passes = lambda i: i.gain is not None and i.gain > least_gain
    free = lambda i: i.col in relaxed
    found = [Pattern((i,), i.support, i.riu, i.gain, (i.id,), free(i)) for i in fit.items if i.riu >= floor and i.riu > 0 and (passes(i) or (free(i) and i.gain is not None))]
    usable = [i for i in fit.items if free(i) or (passes(i) and i.twu >= floor)]
    if deep > 1 and len(usable) > 1:
        found += _extended(fit, usable, deep, floor, least_gain, free)
    own = sorted((p for p in found if not p.relaxed), key=lambda p: (-p.utility, *(-i.twu for i in p.items[:1]), tuple(-i.id for i in p.items)))[:top]
    if relaxed:
        other = sorted((p for p in found if p.relaxed), key=lambda p: (-p.ig, -p.utility, tuple(i.id for i in p.items)))[:top]
        own = sorted(own + other, key=lambda p: (-p.ig, -p.utility, tuple(i.id for i in p.items)))[:top]
    if deep > 1:
        of, kept, seen = _item_covers(fit, [p.items[0] for p in own if len(p.items) == 1]), [], set()
        for p in sorted(own, key=lambda p: (-round(p.ig, 9), -p.utility, tuple(i.id for i in p.items))):
            cover = p.cover if len(p.items) > 1 else of[p.items[0].id]
            if cover not in seen:
                seen.add(cover)
                kept.append(p)
        own = kept
    fit.patterns = own
    return own


def _row(fit: Fit) -> Column:
    """The hash that stands for a transaction in the fingerprint of a set of rows: their number, transactions and combined hashes."""
    return F.xxhash64(*(f"code_{b.name}" for b in fit.bins), "label")


def _item_covers(fit: Fit, items: Sequence[Item]) -> dict[int, tuple]:
    held = fit.rows.select("n", _row(fit).alias("row"), F.explode(ranked(fit, items)).alias("x"))
    return {r[0]: tuple(r[1:]) for r in held.groupBy("x.id").agg(F.sum("n"), F.count("*"), F.bit_xor("row")).collect()}


def _extended(fit: Fit, usable: list[Item], deep: int, floor: float, least_gain: float, free) -> list[Pattern]:
    by_rank = {i.rank: i for i in usable}
    classes = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"c{k}") for k, c in enumerate(fit.classes)]
    occ = fit.rows.select("label", "n", _row(fit).alias("row"), ranked(fit, usable).alias("items")).where(F.size("items") > 1)
    occ = occ.select("*", F.explode("items").alias("x")).select("label", "n", "row", "items", F.array("x.rank").alias("path"), F.array("x.col").alias("cols"), F.col("x.iu").alias("u"))
    population: dict[tuple[int, ...], list[int]] = {(i.rank,): i.counts for i in usable} | {(): fit.totals}
    out: list[Pattern] = []
    held: list[DataFrame] = []
    for size in range(2, deep + 1):
        more = occ.select("*", F.explode(F.filter("items", lambda y: (y["rank"] > F.element_at("path", -1)) & ~F.array_contains("cols", y["col"]))).alias("y"))
        cand = more.select("label", "n", "row", "items", F.concat("path", F.array("y.rank")).alias("path"), F.concat("cols", F.array("y.col")).alias("cols"), (F.col("u") + F.col("y.iu")).alias("u"))
        cand = cand.persist()
        counted = cand.groupBy("path").agg(F.sum("n").alias("n"), F.first("u").alias("u"), F.bit_xor("row").alias("cover"), F.count("*").alias("k"), *classes)
        counted = _gated(fit, counted, size, population, [i.rank for i in usable if free(i)] if size == 2 else [], least_gain).collect()
        alive: set[tuple[int, ...]] = set()
        siblings: set[tuple] = set()
        for r in sorted(counted, key=lambda r: tuple(r["path"])):
            path = tuple(r["path"])
            items = tuple(by_rank[k] for k in path)
            counts = [r[f"c{k}"] for k in range(len(fit.classes))]
            g = gain(counts, population.get(path[: size - 2], fit.totals))
            loose = size == 2 and any(free(i) for i in items)
            if g is None or not (g > least_gain or loose):
                continue
            cover = (r["n"], r["k"], r["cover"])
            if (path[:-1], cover) in siblings:
                continue
            siblings.add((path[:-1], cover))
            alive.add(path)
            population[path] = counts
            u = round(r["n"] * r["u"], 9)
            if u >= floor and u > 0 or loose:
                out.append(Pattern(items, r["n"], u, g, cover, loose))
        held.append(cand)
        if not alive or size == deep:
            break
        keep = fit.rows.sparkSession.createDataFrame([(list(p),) for p in alive], "path array<int>")
        occ = cand.join(F.broadcast(keep) if len(alive) <= 20000 else keep, "path")
    for c in held:
        c.unpersist()
    return out


def _gated(fit: Fit, counted: DataFrame, size: int, population: dict[tuple[int, ...], list[int]], loose: list[int], least_gain: float) -> DataFrame:
    """The counted paths that can pass the gate, so that the driver gets survivors and not all that occur. The bound is a little lower than the gate,
    which is then applied exactly; paths with a rank of `loose` stay."""
    k = len(fit.classes)
    if size == 2:
        counted = counted.withColumn("all", F.array(*(F.lit(int(v)).cast("long") for v in fit.totals)))
    else:
        known = fit.rows.sparkSession.createDataFrame([(list(p), [int(v) for v in c]) for p, c in population.items() if len(p) == size - 2], "_prefix array<int>, all array<bigint>")
        known = F.broadcast(known) if len(population) <= 20000 else known
        counted = counted.withColumn("_prefix", F.slice("path", 1, size - 2)).join(known, "_prefix", "left").withColumn("all", F.coalesce("all", F.array(*(F.lit(int(v)).cast("long") for v in fit.totals)))).drop("_prefix")

    def spread(parts: list[Column]) -> Column:
        """Rows times entropy of the counts of classes."""
        n = sum(parts[1:], parts[0])
        return F.when(n > 0, n * F.ln(n)).otherwise(0.0) - sum((F.when(c > 0, c * F.ln(c)).otherwise(0.0) for c in parts), F.lit(0.0))

    inside, total = [F.col(f"c{j}") for j in range(k)], [F.col("all")[j] for j in range(k)]
    outside = [F.greatest(t - c, F.lit(0)) for t, c in zip(total, inside, strict=True)]
    n = F.greatest(sum(total[1:], total[0]), F.lit(1))
    g = (spread(total) - spread(inside) - spread(outside)) / n
    stays = g > least_gain - 1e-9
    for r in loose:
        stays = stays | F.array_contains("path", r)
    return counted.where(stays).drop("all")


def table_of(spark: SparkSession, patterns: Sequence[Pattern]) -> DataFrame:
    """pattern, length, support, utility and ig (both rounded to 6 places) of each pattern."""
    return spark.createDataFrame([(p.name, len(p.items), int(p.support), round(p.utility, 6), round(p.ig, 6)) for p in patterns], PATTERN)


def pattern_columns(df: DataFrame, fit: Fit) -> DataFrame:
    """df with a column p<k> of 0 or 1 for each pattern: generated conjunctions, so one projection over the rows."""
    coded = apply_bins(df, fit.bins)
    tests = [F.coalesce(_all([F.col(f"code_{i.col}") == i.code for i in p.items]), F.lit(False)).cast("int").alias(f"p{k}") for k, p in enumerate(fit.patterns)]
    return coded.select("*", *tests)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def mine_with_fallback(fit: Fit, top: int, length: int, least_gain: float) -> tuple[list[Pattern], list[dict]]:
    """Mine, and if that gives nothing or fails, again with less: half the patterns, a quarter of length 1, at most 50 of length 1 without a gate."""
    log = []
    for k, n, g in ((top, length, least_gain), (max(1, top // 2), length, least_gain), (max(1, top // 4), 1, least_gain), (min(50, top), 1, 0.0)):
        try:
            found, why = mine(fit, k, n, g), ""
        except Exception as e:  # noqa: BLE001  what went wrong is what the log is for
            found, why = [], type(e).__name__
        log.append({"top": k, "length": n, "least_gain": g, "patterns": len(found), "error": why})
        if found:
            return found, log
    return [], log
