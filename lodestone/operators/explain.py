"""What patterns a model rests on: sources, families, costs of inspection, edits and their record."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.mining import Fit


def provenance(spark: SparkSession, fit: Fit) -> DataFrame:
    """A row for each item of each pattern: pattern, position, col, code, label."""
    rows = [(p.name, k, i.col, i.code, i.label) for p in fit.patterns for k, i in enumerate(p.items)]
    return spark.createDataFrame(rows, "pattern string, position int, col string, code int, label string")


def lineage(spark: SparkSession, fit: Fit) -> DataFrame:
    """For each source column the patterns that use it, their mean support and the largest gain."""
    rows = [(i.col, p.name, int(p.support), p.ig) for p in fit.patterns for i in p.items]
    df = spark.createDataFrame(rows, "source string, pattern string, support long, ig double")
    return df.groupBy("source").agg(F.count_distinct("pattern").alias("patterns"), F.round(F.avg("support"), 6).alias("mean_support"), F.round(F.max("ig"), 6).alias("best_ig"))


def families(spark: SparkSession, fit: Fit) -> DataFrame:
    """Patterns by length and set of source columns."""
    rows = [(len(p.items), ", ".join(sorted({i.col for i in p.items}))) for p in fit.patterns]
    return spark.createDataFrame(rows, "length int, sources string").groupBy("length", "sources").agg(F.count("*").alias("patterns"))


def sensitive(spark: SparkSession, fit: Fit, columns: Sequence[str]) -> DataFrame:
    rows = [(p.name, any(i.col in columns for i in p.items)) for p in fit.patterns]
    return spark.createDataFrame(rows, "pattern string, sensitive boolean")


def inspection_units(matrix: DataFrame, fit: Fit, weights: Sequence[float] | None = None) -> DataFrame:
    """One row: conditions in the whole model, and conditions that are active in a row, on average with a 95 % interval.

    Patterns with weight 0 don't count; without weights all do."""
    used = [k for k in range(len(fit.patterns)) if weights is None or weights[k]]
    active = sum((F.col(f"p{k}") * len(fit.patterns[k].items) for k in used), F.lit(0))
    total = sum(len(fit.patterns[k].items) for k in used)
    half = 1.96 * F.stddev_samp("u") / F.sqrt(F.count("u"))
    return matrix.select(active.alias("u")).agg(F.lit(total).alias("model_units"), F.round(F.avg("u"), 6).alias("instance_units"), F.round(F.avg("u") - half, 6).alias("low"), F.round(F.avg("u") + half, 6).alias("high"))


def edit(patterns: DataFrame, keyword: str | None = None, least_support: float = 0.0, rows: int = 0) -> DataFrame:
    """pattern, support and status: kept, or why it goes."""
    status = F.when(F.lit(keyword is not None) & F.contains(F.lower("pattern"), F.lit((keyword or "").lower())), "keyword").when(F.col("support") / max(1, rows) < least_support, "low support").otherwise("kept")
    return patterns.select("pattern", "support", status.alias("status"))


def model_card(fit: Fit, name: str, intended: str = "", limits: Sequence[str] = ()) -> str:
    """A card as JSON: what the model was fitted on and what it consists of."""
    return json.dumps({
        "name": name, "intended_use": intended, "limitations": list(limits), "rows": sum(fit.totals), "classes": fit.classes, "class_counts": fit.totals,
        "columns": [{"name": b.name, "kind": b.kind, "bins": b.size} for b in fit.bins],
        "patterns": [{"pattern": p.name, "support": p.support, "utility": round(p.utility, 6), "ig": round(p.ig, 6)} for p in fit.patterns],
    }, indent=2)


def stability(a: DataFrame, b: DataFrame, top: int = 20) -> DataFrame:
    """One row: Jaccard similarity of the top patterns by gain of two fits (pattern, ig), and the rank correlation of the gains of shared ones.

    Tables of patterns are small; ranks average ties.
    """
    from pyspark.sql import Window

    def ranked(df: DataFrame, name: str) -> DataFrame:
        best = df.orderBy(F.desc("ig"), "pattern").limit(top)
        r = F.rank().over(Window.partitionBy(F.lit(0)).orderBy("ig")) + (F.count("*").over(Window.partitionBy("ig")) - 1) / 2
        return best.select("pattern", r.alias(name))

    both = ranked(a, "x").join(ranked(b, "y"), "pattern", "full")
    shared = F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int"))
    return both.agg(F.round(F.try_divide(shared, F.count("*")), 6).alias("jaccard"), shared.alias("shared"), F.round(F.nanvl(F.corr("x", "y"), F.lit(None).cast("double")), 6).alias("rank_correlation"))


def bill_of_materials(names: Sequence[str] = ("pyspark", "numpy", "pyarrow", "pandas")) -> str:
    """Installed versions of what the library stands on, as JSON."""
    from importlib.metadata import PackageNotFoundError, version

    out = []
    for name in names:
        try:
            out.append({"name": name, "version": version(name)})
        except PackageNotFoundError:
            continue
    return json.dumps({"components": out}, indent=2)


def audit(fit: Fit, log: Sequence[dict]) -> str:
    """What mining tried and what came of it, as JSON."""
    return json.dumps({"attempts": list(log), "patterns": len(fit.patterns), "items": len(fit.items), "rows": sum(fit.totals)}, indent=2)
