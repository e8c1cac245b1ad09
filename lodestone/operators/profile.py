"""Profiles of columns and of associations between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.information import finite
from lodestone.operators.quantiles import percentiles


def _rows(parts: dict[str, dict[str, Column]], df: DataFrame) -> DataFrame:
    """One aggregation for all columns, then a row for each."""
    flat = df.agg(*(v.alias(f"{c}__{k}") for c, by in parts.items() for k, v in by.items()))
    return flat.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), *(F.col(f"{c}__{k}").alias(k) for k in by)) for c, by in parts.items()))).alias("x")).select("x.*")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, moments, quartiles and values beyond 1.5 interquartile ranges; the skewness is corrected for bias."""
    q = percentiles(df, {c: finite(c) for c in columns}, (0.25, 0.5, 0.75))
    parts = {}
    for c in columns:
        x = finite(c)
        n = F.count(x)
        q1, med, q3 = q[c] or (None, None, None)
        far = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)) if q[c] and q3 > q1 else F.lit(False)
        parts[c] = {
            "n": n, "missing": F.sum(x.isNull().cast("int")), "mean": F.round(F.avg(x), 8), "std": F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6), "low": F.round(F.min(x), 6),
            "q1": F.round(F.lit(q1).cast("double"), 6), "median": F.round(F.lit(med).cast("double"), 6), "q3": F.round(F.lit(q3).cast("double"), 6), "high": F.round(F.max(x), 6),
            "skewness": F.round(F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0), 6), "zeros": F.sum(F.coalesce((x == 0).cast("int"), F.lit(0))), "negative": F.sum(F.coalesce((x < 0).cast("int"), F.lit(0))),
            "outliers": F.sum(F.coalesce(far.cast("int"), F.lit(0))),
        }
    return _rows(parts, df)


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(values).alias("v")).groupBy("v.col", "v.value").agg(F.count("*").alias("n"))


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, distinct values, mode (smallest of ties), rare levels and entropy in bits of each column."""
    counts = level_counts(df, columns)
    some = F.col("value").isNotNull()
    total = F.sum(F.when(some, F.col("n")).otherwise(0)).over(Window.partitionBy("col"))
    c = counts.withColumn("total", total)
    p = F.col("n") / F.col("total")
    return c.groupBy("col").agg(
        F.first("total").alias("n"), F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("missing"), F.sum(some.cast("long")).alias("levels"),
        F.min(F.when(some, F.struct((-F.col("n")).alias("k"), "value"))).alias("top"), F.sum((some & (F.col("n") < F.greatest(F.lit(2), F.floor(F.col("total") * 0.01)))).cast("long")).alias("rare"),
        F.round(F.sum(F.when(some, -p * F.log2(p)).otherwise(0.0)), 6).alias("entropy"),
    ).select("col", "n", "missing", "levels", F.col("top.value").alias("mode"), (-F.col("top.k")).alias("mode_count"), "rare", "entropy")


def datetime_profile(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row: count, distinct, first, last, span in seconds, and the commonest step in seconds between consecutive values of a key."""
    x = F.col(column)
    base = df.agg(F.count(x).alias("n"), F.count_distinct(x).alias("distinct_values"), F.min(x).alias("first"), F.max(x).alias("last"), (F.unix_timestamp(F.max(x)) - F.unix_timestamp(F.min(x))).alias("span"))
    step = F.unix_timestamp(x) - F.unix_timestamp(F.lag(x).over(Window.partitionBy(key).orderBy(x)))
    common = df.where(x.isNotNull()).select(step.alias("step")).where("step is not null").groupBy("step").count().agg(F.min(F.struct((-F.col("count")).alias("k"), "step")).alias("m"))
    return base.crossJoin(common.select(F.col("m.step").alias("common_step")))


def text_profile(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.agg(F.count(x).alias("n"), F.count_distinct(x).alias("distinct_values"), F.round(F.avg(F.char_length(x)), 6).alias("mean_length"), F.max(F.char_length(x)).alias("longest"), F.sum(F.coalesce((F.trim(x) == "").cast("int"), F.lit(0))).alias("blank"))


def missing_patterns(df: DataFrame, columns: Sequence[str], limit: int = 20) -> DataFrame:
    """The commonest combinations of missing columns; `Complete` for none."""
    named = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))
    counts = df.groupBy(F.when(named == "", "Complete").otherwise(named).alias("pattern")).agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2)).orderBy(F.desc("n"), "pattern").limit(limit)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, Cramér's V of two columns, corrected for bias; missing values are a level."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<missing>"))
    cells = df.groupBy(level(a).alias("a"), level(b).alias("b")).agg(F.count("*").alias("n"))
    wa, wb, w = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy(F.lit(0))
    c = cells.select("a", "b", "n", F.sum("n").over(wa).alias("na"), F.sum("n").over(wb).alias("nb"), F.sum("n").over(w).alias("t"))
    # The chi-squared sum over all cells, empty ones included, is t * (sum n^2 / (na * nb) - 1).
    r = c.agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.first("t").alias("t"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"))
    fix = r.select("r", "k", "t", F.greatest(F.col("s") - 1 - (F.col("k") - 1) * (F.col("r") - 1) / F.greatest(F.col("t") - 1, F.lit(1)), F.lit(0.0)).alias("phi"))
    less = lambda x: F.col(x) - (F.col(x) - 1) ** 2 / F.greatest(F.col("t") - 1, F.lit(1))
    denominator = F.least(less("k"), less("r")) - 1
    return fix.select(F.round(F.when((F.least("r", "k") >= 2) & (denominator > 0), F.sqrt(F.col("phi") / denominator)).otherwise(0.0), 6).alias("v"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row, eta: the root of the share of variance between groups."""
    g = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(F.lit(0))
    mean = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    c = g.select("n", "v", F.col("n") * (F.col("m") - mean) ** 2)
    between, inside = F.sum(c.columns[-1]), F.sum(F.col("n") * F.col("v"))
    return c.agg(F.round(F.when(between + inside > 0, F.sqrt(between / (between + inside))).otherwise(0.0), 6).alias("eta"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row, rows that repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def semantic_types(df: DataFrame) -> DataFrame:
    """col, distinct, missing and kind of each column: constant, binary, identifier, integer, continuous, category, text, datetime."""
    stats = _rows({c: {"distinct_values": F.count_distinct(F.col(c).cast("string")), "missing": F.sum(F.col(c).isNull().cast("int")), "rows": F.count(F.lit(1)), "mean_length": F.avg(F.char_length(F.col(c).cast("string")))} for c in df.columns}, df)
    kind = F.when(F.col("distinct_values") <= 1, "constant").when(F.col("distinct_values") == 2, "binary")
    types = dict(df.dtypes)
    dates = [c for c, t in types.items() if t.startswith(("timestamp", "date"))]
    whole = [c for c, t in types.items() if t in ("tinyint", "smallint", "int", "bigint")]
    real = [c for c, t in types.items() if t in ("float", "double") or t.startswith("decimal")]
    kind = kind.when(F.col("col").isin(dates), "datetime").when((F.col("distinct_values") == F.col("rows")) & ~F.col("col").isin(real), "identifier").when(F.col("col").isin(real), "continuous")
    kind = kind.when(F.col("col").isin(whole), "integer").when(F.col("mean_length") > 60, "text").otherwise("category")
    return stats.select("col", "distinct_values", "missing", kind.alias("kind"))


def pivot(df: DataFrame, rows: str, columns: str, value: str, how: str = "avg", most: int = 1000) -> DataFrame:
    """A row for each value of `rows`, a column for each of `columns`; more than `most` of these raise an error rather than make a plan of any width."""
    levels = [r[0] for r in df.select(columns).distinct().limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{columns} has more than {most} values")
    return df.groupBy(rows).pivot(columns, sorted(v for v in levels if v is not None)).agg(F.round(getattr(F, how)(value), 6))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n and the cell's share of its row; missing values are a level."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c)
    cells = df.groupBy(level(a), level(b)).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(a)), 6))


def target_associations(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], top: int = 20) -> DataFrame:
    """col, measure and strength of the columns that go most with a categorical target: eta of numbers, Cramér's V of categories.

    One scan counts all columns by value of the target; what is windowed afterwards has a row for each level.
    """
    some = df.where(F.col(target).isNotNull())
    t = F.col(target).cast("string").alias("t")
    parts = []
    if numeric:
        cells = some.select(t, F.explode(F.array(*(F.struct(F.lit(c).alias("col"), finite(c).alias("x")) for c in numeric))).alias("v")).select("t", "v.*").where("x is not null")
        g = cells.groupBy("col", "t").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
        w = Window.partitionBy("col")
        g = g.withColumn("far", F.col("n") * (F.col("m") - F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)) ** 2)
        between, inside = F.sum("far"), F.sum(F.col("n") * F.col("v"))
        parts.append(g.groupBy("col").agg(F.lit("eta").alias("measure"), F.when(between + inside > 0, F.sqrt(between / (between + inside))).otherwise(0.0).alias("strength")))
    if categorical:
        level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<missing>"))
        cells = some.select(t, F.explode(F.array(*(F.struct(F.lit(c).alias("col"), level(c).alias("x")) for c in categorical))).alias("v")).groupBy("v.col", "v.x", "t").agg(F.count("*").alias("n"))
        by = lambda *c: F.sum("n").over(Window.partitionBy(*c))
        c = cells.select("col", "x", "t", "n", by("col", "x").alias("nx"), by("col", "t").alias("nt"), by("col").alias("all"))
        r = c.groupBy("col").agg(F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("nt"))).alias("s"), F.first("all").alias("all"), F.count_distinct("x").alias("r"), F.count_distinct("t").alias("k"))
        rest = F.greatest(F.col("all") - 1, F.lit(1))
        phi = F.greatest(F.col("s") - 1 - (F.col("k") - 1) * (F.col("r") - 1) / rest, F.lit(0.0))
        less = F.least(F.col("k") - (F.col("k") - 1) ** 2 / rest, F.col("r") - (F.col("r") - 1) ** 2 / rest) - 1
        parts.append(r.select("col", F.lit("cramers_v").alias("measure"), F.when((F.least("r", "k") >= 2) & (less > 0), F.sqrt(phi / less)).otherwise(0.0).alias("strength")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("strength", F.round("strength", 6)).orderBy(F.desc("strength"), "col").limit(top)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their percentage, columns without a value and with one only."""
    flat = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"n_{k}") for k, c in enumerate(df.columns)), *(F.min(c).alias(f"lo_{k}") for k, c in enumerate(df.columns)), *(F.max(c).alias(f"hi_{k}") for k, c in enumerate(df.columns)))
    total = lambda f: sum((f(k) for k in range(len(df.columns))), F.lit(0))
    missing = total(lambda k: F.col("rows") - F.col(f"n_{k}"))
    empty = total(lambda k: (F.col(f"n_{k}") == 0).cast("int"))
    constant = total(lambda k: ((F.col(f"n_{k}") > 0) & (F.col(f"lo_{k}") == F.col(f"hi_{k}"))).cast("int"))
    return flat.select("rows", F.lit(len(df.columns)).alias("columns"), missing.cast("long").alias("missing_cells"), F.round(F.try_divide(100 * missing, F.col("rows") * len(df.columns)), 6).alias("missing_pct"), empty.alias("all_missing"), constant.alias("constant"))


def findings(df: DataFrame, target: str | None = None, id_column: str | None = None) -> DataFrame:
    """level, title and detail of what a reader of the profile should know; level 'ok' alone if there is nothing."""
    n = df.count()
    out: list[tuple[str, str, str]] = []
    if not n:
        out = [("warning", "Empty dataset", "no rows")]
    else:
        twice = duplicate_rows(df).first()[0]
        if twice:
            out.append(("warning", "Duplicate rows", f"{twice} rows repeat another"))
        for r in sorted(semantic_types(df).collect(), key=lambda r: df.columns.index(r["col"])):
            if r["missing"] == n:
                out.append(("warning", r["col"], "no value"))
            elif r["kind"] == "constant":
                out.append(("warning", r["col"], "one value"))
            elif r["kind"] == "identifier" and r["col"] != id_column:
                out.append(("attention", r["col"], "as many values as rows, as an identifier has"))
            elif r["kind"] == "category" and r["distinct_values"] > 100:
                out.append(("attention", r["col"], f"{r['distinct_values']} levels"))
            if r["missing"] >= 0.4 * n:
                out.append(("warning", r["col"], f"{100 * r['missing'] / n:.1f} % missing"))
        if target is not None:
            small = df.groupBy(target).count().agg(F.min("count"), F.count("*")).first()
            if small[1] >= 2 and small[0] < 0.1 * n:
                out.append(("warning", "Target imbalance", f"the smallest class has {100 * small[0] / n:.1f} % of the rows"))
    return df.sparkSession.createDataFrame(out[:30] or [("ok", "Nothing found", "")], "level string, title string, detail string")
