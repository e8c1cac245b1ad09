"""Encoding of raw columns and choice of features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.information import finite
from lodestone.operators.binning import kind_of
from lodestone.operators.quantiles import percentiles


def zero_variance(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value, missing and non-finite ones aside."""
    r = df.agg(*(F.count_distinct(finite(c) if kind_of(df, c) == "float" else F.col(c)).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if r[c] <= 1]


def case_id(df: DataFrame, order: str) -> DataFrame:
    """df with case_id CASE-000001 and so on by an integer key: ranks are offsets of key ranges plus ranks within, not one global sort."""
    from pyspark.sql import Window

    b = df.withColumn("_b", F.floor(F.col(order) / 4096))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = b.join(before, "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    return ranked.withColumn("case_id", F.format_string("CASE-%06d", F.col("_r"))).drop("_b", "_r", "_before")


def indicators(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """A 0/1 expression by name for each level, in order, and one for missing; unseen levels are all 0."""
    levels = df.agg(*(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns)).first()
    made = {f"{c}={v}": F.col(c).cast("string").eqNullSafe(F.lit(v)).cast("int") for c in columns for v in levels[c]}
    return made | {f"{c}=<NA>": F.col(c).isNull().cast("int") for c in columns}


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with a column for each of `indicators`."""
    return df.select("*", *(v.alias(k) for k, v in indicators(df, columns).items()))


def standardised(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """z_<name> as expressions: missing values become the median, then mean 0 and (population) deviation 1."""
    m = percentiles(df, {c: finite(c) for c in columns}, (0.5,))
    full = {c: F.coalesce(finite(c), F.lit((m[c] or [0.0])[0])) for c in columns}
    s = df.agg(*(f(full[c]).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {f"z_{c}": (full[c] - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in columns}


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with a column for each of `standardised`."""
    return df.select("*", *(v.alias(k) for k, v in standardised(df, columns).items()))


def encoded(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[Column]:
    """Standardised numbers and one-hot levels as expressions over df's columns."""
    return [*(standardised(df, numeric) if numeric else {}).values(), *(indicators(df, categorical) if categorical else {}).values()]


def target_mean(df: DataFrame, column: str, label: str = "label", least: float = 20.0, smooth: float = 10.0) -> DataFrame:
    """Levels with counts and smoothed means: s * mean + (1 - s) * prior, s = 1 / (1 + exp(-(n - least) / smooth))."""
    prior = df.agg(F.avg(label)).first()[0]
    g = df.groupBy(column).agg(F.count("*").alias("n"), F.avg(label).alias("mean"))
    s = 1 / (1 + F.exp(-(F.col("n") - least) / smooth))
    return g.select(column, "n", F.round(s * F.col("mean") + (1 - s) * prior, 6).alias("encoded"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    n = df.count()
    return df.groupBy(column).agg(F.round(F.count("*") / n, 6).alias("encoded"))


def ordinal(df: DataFrame, column: str) -> DataFrame:
    levels = df.agg(F.sort_array(F.collect_set(column))).first()[0]
    return df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(levels)], f"{column} {dict(df.dtypes)[column]}, encoded int")


def quartile_scores(df: DataFrame, columns: Sequence[str], label: str = "label", eps: float = 1e-15) -> DataFrame:
    """feature, ig: gain in bits of each column cut at its quartiles, by one histogram of all columns."""
    q = percentiles(df, {c: finite(c) for c in columns}, [k / 4 for k in range(5)])
    cells = []
    for c in columns:
        e = sorted(set(q[c] or []))
        cells.append(F.struct(F.lit(c).alias("feature"), sum((F.when(finite(c) >= v, 1).otherwise(0) for v in e[1:-1]), F.lit(0)).alias("code"), finite(c).isNotNull().alias("ok")))
    hist = df.select(label, F.explode(F.array(*cells)).alias("v")).where("v.ok").groupBy("v.feature", "v.code", label).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    by = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    t = hist.select("feature", "n", by("feature", "code").alias("s"), by("feature", label).alias("k"), by("feature").alias("t"))
    inner = -F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("s") + eps)
    outer = -F.col("n") / F.col("t") * F.log2(F.col("k") / F.col("t") + eps)  # summed over bins this is the entropy of the label
    return t.groupBy("feature").agg(F.round(F.sum(outer) - F.sum(inner), 6).alias("ig"))


def strict_top(scores: DataFrame, k: int) -> DataFrame:
    """The k features with the largest scores, names breaking ties."""
    return scores.orderBy(F.desc("ig"), "feature").limit(k)


def lags(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """df with <column>_lag_<k>, the value k rows before within the key; null before the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in steps})


def infer_target(df: DataFrame) -> str | None:
    """The last column, if it has more than one and at most max(20, a tenth of the rows) distinct values."""
    c = df.columns[-1]
    d, n = df.agg(F.count_distinct(c), F.count("*")).first()
    return c if 1 < d <= max(20, math.floor(0.1 * n)) else None
