"""Statistics of model comparisons: (dataset, model, value) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(df: DataFrame, p: str = "p", name: str = "name") -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - rank) * p, at most 1. The table is one of comparisons."""
    w = Window.partitionBy(F.lit(0))
    o = w.orderBy(p, name)
    scaled = F.least((F.count("*").over(w) - F.row_number().over(o) + 1) * F.col(p), F.lit(1.0))
    step = df.select(name, p, scaled.alias("s"))
    return step.select(name, p, F.round(F.max("s").over(o.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("adjusted"))


def matched(df: DataFrame) -> DataFrame:
    """Rows of datasets on which every model has a value."""
    models = df.select("model").distinct().count()
    full = df.where("value is not null").groupBy("dataset").agg(F.count_distinct("model").alias("k")).where(F.col("k") == models).select("dataset")
    return df.join(full, "dataset", "left_semi")


def average_ranks(df: DataFrame) -> DataFrame:
    """Mean rank (1 is best) of each model over datasets; ties share the mean of their ranks."""
    w = Window.partitionBy("dataset")
    r = F.rank().over(w.orderBy(F.desc("value"))) + (F.count("*").over(Window.partitionBy("dataset", "value")) - 1) / 2
    return df.select("model", r.alias("r")).groupBy("model").agg(F.round(F.avg("r"), 6).alias("rank"), F.count("*").alias("datasets"))


def mean_interval(df: DataFrame, by: str = "model", value: str = "value", z: float = 1.96) -> DataFrame:
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(value) - half, 6).alias("low"), F.round(F.avg(value) + half, 6).alias("high"))


def leaderboard(df: DataFrame) -> DataFrame:
    """model, datasets, mean value, mean rank and datasets where it is best (ties count for each), best mean rank first."""
    w = Window.partitionBy("dataset")
    rank = F.rank().over(w.orderBy(F.desc("value")))
    r = df.where("value is not null").select("model", "value", (rank + (F.count("*").over(Window.partitionBy("dataset", "value")) - 1) / 2).alias("r"), (rank == 1).cast("int").alias("first"))
    out = r.groupBy("model").agg(F.count("*").alias("datasets"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("r"), 6).alias("rank"), F.sum("first").alias("firsts"))
    return out.orderBy("rank", "model")


def wins(df: DataFrame) -> DataFrame:
    """For each pair of models the shares of common datasets that each wins; ties count half. Pairs are made inside a dataset's list of models."""
    l = df.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("model", "value"))).alias("v"))  # noqa: E741
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("a"), b["model"].alias("b"), F.when(a["value"] > b["value"], 1.0).when(a["value"] < b["value"], 0.0).otherwise(0.5).alias("w")))))
    return l.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.w").alias("wins"), F.count("*").alias("n"))


def elo(df: DataFrame, rounds: int = 500, rate: float = 8.0, base: float = 1000.0) -> DataFrame:
    """Ratings that explain the shares of wins, centred on base; the solver sees one row for each pair of models."""
    rows = wins(df).collect()
    names = sorted({m for r in rows for m in (r["a"], r["b"])})
    rating = dict.fromkeys(names, 0.0)
    for _ in range(rounds):
        push = dict.fromkeys(names, 0.0)
        for r in rows:
            expected = 1 / (1 + 10 ** ((rating[r["b"]] - rating[r["a"]]) / 400))
            d = r["wins"] / r["n"] - expected
            push[r["a"]] += d
            push[r["b"]] -= d
        rating = {m: v + rate * push[m] for m, v in rating.items()}
    mean = sum(rating.values()) / max(1, len(rating))
    return df.sparkSession.createDataFrame([(m, round(base + v - mean, 3)) for m, v in rating.items()], "model string, rating double")


def jaccard(a: DataFrame, b: DataFrame, key: str = "pattern") -> DataFrame:
    """One row: shared, added and removed keys and their Jaccard similarity."""
    both = a.select(key).distinct().withColumn("x", F.lit(1)).join(b.select(key).distinct().withColumn("y", F.lit(1)), key, "full")
    r = both.agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("x").isNull(), 1)).alias("added"), F.count(F.when(F.col("y").isNull(), 1)).alias("removed"))
    return r.select("*", F.round(F.try_divide("shared", F.col("shared") + F.col("added") + F.col("removed")), 6).alias("jaccard"))
