"""Distances between a reference and a current distribution, and monitoring in windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.information import finite
from lodestone.operators.quantiles import percentiles

EPS = 1e-6


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10, part: str = "part") -> DataFrame:
    """col, bin, ref, cur: counts in equal-width bins between the reference's extremes, the last closed; values beyond are dropped."""
    x = {c: finite(c) for c in columns}
    r = df.where(F.col(part) == "reference").agg(*(f(x[c]).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max)))).first()
    cells = []
    for c in columns:
        lo, hi = r[f"lo_{c}"], r[f"hi_{c}"]
        if lo is None:
            continue
        lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
        edges = [lo + (hi - lo) * k / bins for k in range(1, bins)]
        code = sum((F.when(x[c] >= e, 1).otherwise(0) for e in edges), F.lit(0))
        cells.append(F.struct(F.lit(c).alias("col"), F.when((x[c] >= lo) & (x[c] <= hi), code).alias("bin")))
    found = df.select(part, F.explode(F.array(*cells)).alias("v")).where("v.bin is not null")
    counts = found.groupBy("v.col", "v.bin").agg(F.sum((F.col(part) == "reference").cast("long")).alias("ref"), F.sum((F.col(part) != "reference").cast("long")).alias("cur"))
    grid = df.sparkSession.createDataFrame([(c, k) for c in columns for k in range(bins)], "col string, bin int")
    return grid.join(counts, ["col", "bin"], "left").select("col", "bin", F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("cur", F.lit(0)).alias("cur"))


def divergence(df: DataFrame, columns: Sequence[str], bins: int = 10, threshold: float = 0.1) -> DataFrame:
    """psi, symmetric kl and severity of each column."""
    w = Window.partitionBy("col")
    p = F.col("ref") / (F.sum("ref").over(w) + EPS) + EPS
    q = F.col("cur") / (F.sum("cur").over(w) + EPS) + EPS
    shares = histogram(df, columns, bins).select("col", p.alias("p"), q.alias("q"))
    psi = F.round(F.greatest(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))), F.lit(0.0)), 6)
    kl = F.round(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q")) + F.col("q") * F.ln(F.col("q") / F.col("p"))) / 2, 6)
    out = shares.groupBy("col").agg(psi.alias("psi"), kl.alias("kl"))
    return out.select("*", F.when(F.col("psi") > max(0.25, 2 * threshold), "significant").when(F.col("psi") > threshold, "moderate").otherwise("none").alias("severity"))


def summary(df: DataFrame, columns: Sequence[str], bins: int = 10, threshold: float = 0.1) -> DataFrame:
    """One row: mean psi and kl over columns, columns beyond the threshold, and the severity of the mean."""
    d = divergence(df, columns, bins, threshold).agg(F.avg("psi").alias("psi"), F.avg("kl").alias("kl"), F.sum((F.col("psi") > threshold).cast("int")).alias("drifted"))
    severity = F.when(F.col("psi") > max(0.25, 2 * threshold), "significant").when(F.col("psi") > threshold, "moderate").otherwise("none")
    return d.select(F.round("psi", 5).alias("psi"), F.round("kl", 5).alias("kl"), "drifted", severity.alias("severity"))


def quantile_psi(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row, psi over right-closed bins at the reference's quantiles with open ends; null for fewer than 10 rows or two bins."""
    x = finite(column)
    ref = F.col("part") == "reference"
    q = percentiles(df.where(ref), {column: x}, [k / bins for k in range(bins + 1)])[column] or []
    edges = sorted(set(q))
    code = sum((F.when(x > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counts = df.where(x.isNotNull()).groupBy(code.alias("bin")).agg(F.sum(ref.cast("long")).alias("r"), F.sum((~ref).cast("long")).alias("c"))
    grid = df.sparkSession.range(max(1, len(edges) - 1)).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    w = Window.partitionBy(F.lit(0))
    share = lambda k: F.greatest(F.col(k) / F.greatest(F.sum(k).over(w), F.lit(1)), F.lit(EPS))
    cells = grid.select(share("r").alias("p"), share("c").alias("q"), F.sum("r").over(w).alias("nr"), F.sum("c").over(w).alias("nc"))
    psi = F.when((F.max("nr") >= 10) & (F.max("nc") >= 10) & F.lit(len(edges) >= 3), F.round(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))), 6))
    return cells.agg(psi.alias("psi"))


def ks(df: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """One row, the largest distance of the two cumulative distributions.

    Values are counted first; running sums are taken within buckets of the value range, each shifted by the totals of those before.
    """
    x, ref = finite(column), F.col("part") == "reference"
    counts = df.select(x.alias("x"), ref.alias("ref")).where("x is not null").groupBy("x").agg(F.sum(F.col("ref").cast("long")).alias("r"), F.sum((~F.col("ref")).cast("long")).alias("c"))
    lo, hi, nr, nc = counts.agg(F.min("x"), F.max("x"), F.sum("r"), F.sum("c")).first()
    if (nr or 0) < 10 or (nc or 0) < 10:
        return df.sparkSession.createDataFrame([(None,)], "ks double")
    by = counts.withColumn("b", F.floor((F.col("x") - lo) / (((hi - lo) or 1.0) / buckets)))
    coarse = by.groupBy("b").agg(F.sum("r").alias("br"), F.sum("c").alias("bc"))
    w0 = Window.partitionBy(F.lit(0)).orderBy("b")
    below = coarse.select("b", (F.sum("br").over(w0) - F.col("br")).alias("ur"), (F.sum("bc").over(w0) - F.col("bc")).alias("uc"))
    w = Window.partitionBy("b").orderBy("x")
    at = by.select("b", F.sum("r").over(w).alias("sr"), F.sum("c").over(w).alias("sc")).join(below, "b")
    return at.agg(F.round(F.max(F.abs((F.col("sr") + F.col("ur")) / nr - (F.col("sc") + F.col("uc")) / nc)), 6).alias("ks"))


def total_variation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Half the absolute difference of the shares of each categorical column's values, missing ones as a value."""
    ref = F.col("part") == "reference"
    values = F.array(*(F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("value")) for c in columns))
    counts = df.select("part", F.explode(values).alias("v")).groupBy("v.col", "v.value").agg(F.sum(ref.cast("long")).alias("r"), F.sum((~ref).cast("long")).alias("c"))
    w = Window.partitionBy("col")
    return counts.select("col", F.abs(F.col("r") / F.sum("r").over(w) - F.col("c") / F.sum("c").over(w)).alias("d")).groupBy("col").agg(F.round(F.sum("d") / 2, 6).alias("tvd"))


def label_drift(df: DataFrame, label: str) -> DataFrame:
    """Change of each reference label's share."""
    ref = F.col("part") == "reference"
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.sum(ref.cast("long")).alias("r"), F.sum((~ref).cast("long")).alias("c"))
    w = Window.partitionBy(F.lit(0))
    out = counts.select("label", "r", F.round(F.col("c") / F.sum("c").over(w) - F.col("r") / F.sum("r").over(w), 6).alias("change"))
    return out.where("r > 0").select("label", "change")


def monitor(df: DataFrame, ts: str = "ts", value: str = "value", kind: str = "event_type", every: str = "1 day") -> DataFrame:
    """Counts, mean, spread and percentiles of a value in tumbling windows; batch or streaming but for the exact percentiles."""
    w = F.window(ts, every)
    return df.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"), *(F.round(F.percentile(value, q), 6).alias(f"p{int(100 * q)}") for q in (0.5, 0.95, 0.99))).select(F.col("w.start").alias("start"), kind, "n", "mean", "low", "high", "p50", "p95", "p99")
