"""Treatment effects from predictions, and diagnostics of balance and overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import features, models, sampling


def arms(df: DataFrame, t: str = "t", y: str = "y") -> DataFrame:
    """Rows in each cell of treatment and outcome."""
    return df.groupBy(t, y).agg(F.count("*").alias("n"))


def balance(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], t: str = "t") -> DataFrame:
    """Standardised mean difference of numbers, largest gap of shares of categories, and a flag beyond 0.1."""
    treated = F.col(t) == 1
    parts = []
    for c in numeric:
        x1, x0 = F.when(treated, F.col(c)), F.when(~treated, F.col(c))
        parts.append((c, F.try_divide(F.avg(x1) - F.avg(x0), F.sqrt((F.var_samp(x1) + F.var_samp(x0)) / 2))))
    flat = df.agg(*(v.alias(c) for c, v in parts))
    num = flat.select(F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.lit("numeric").alias("type"), F.col(c).alias("d")) for c, _ in parts))).alias("x")).select("x.*")
    values = F.array(*(F.struct(F.lit(c).alias("covariate"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("value")) for c in categorical))
    counts = df.select(t, F.explode(values).alias("v")).groupBy("v.covariate", "v.value").agg(F.sum(treated.cast("long")).alias("n1"), F.sum((~treated).cast("long")).alias("n0"))
    w = Window.partitionBy("covariate")
    gap = F.abs(F.col("n1") / F.sum("n1").over(w) - F.col("n0") / F.sum("n0").over(w))
    cat = counts.select("covariate", gap.alias("g")).groupBy("covariate").agg(F.max("g").alias("d")).select("covariate", F.lit("categorical").alias("type"), "d")
    return num.unionByName(cat).select("covariate", "type", F.round("d", 6).alias("difference"), F.when(F.abs("d") > 0.1, "Review").otherwise("OK").alias("flag"))


def effects(df: DataFrame, trims: Sequence[float] = (0.0, 0.01, 0.05, 0.10), clip: float = 0.01, t: str = "t", y: str = "y") -> DataFrame:
    """Plug-in and doubly robust average effects by trimming of the propensity e, from predictions mu0 and mu1: trim, retained, plug_in, aipw.

    With a column `repeat` the estimates are averaged over repeats, and spread is their standard deviation.
    """
    bound = lambda c, lo: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(1 - lo))
    repeat = F.col("repeat") if "repeat" in df.columns else F.lit(0)
    b = df.select(repeat.alias("repeat"), F.col(t).alias("t"), F.col(y).alias("y"), bound("e", clip).alias("e"), bound("mu0", 1e-6).alias("m0"), bound("mu1", 1e-6).alias("m1"))
    dr = F.col("m1") - F.col("m0") + F.col("t") * (F.col("y") - F.col("m1")) / F.col("e") - (1 - F.col("t")) * (F.col("y") - F.col("m0")) / (1 - F.col("e"))
    rows = b.select("repeat", "e", (F.col("m1") - F.col("m0")).alias("p"), dr.alias("dr"), F.explode(F.array(*map(F.lit, trims))).alias("trim"))
    inside = (F.col("e") >= F.col("trim")) & (F.col("e") <= 1 - F.col("trim"))
    each = rows.groupBy("trim", "repeat").agg(F.avg(inside.cast("int")).alias("kept"), F.avg("p").alias("p"), F.avg(F.when(inside, F.col("dr"))).alias("dr"))
    return each.groupBy("trim").agg(F.round(F.avg("kept"), 6).alias("retained"), F.round(F.avg("p"), 6).alias("plug_in"), F.round(F.avg("dr"), 6).alias("aipw"), F.round(F.coalesce(F.stddev_samp("dr"), F.lit(0.0)), 6).alias("spread"))


def overlap(df: DataFrame, e: str = "e", t: str = "t", low: float = 0.05) -> DataFrame:
    """One row for each arm: rows, share of propensities in [low, 1 - low], their mean and extremes."""
    inside = ((F.col(e) >= low) & (F.col(e) <= 1 - low)).cast("int")
    return df.groupBy(t).agg(F.count("*").alias("n"), F.round(F.avg(inside), 6).alias("overlap"), F.round(F.avg(e), 6).alias("mean"), F.round(F.min(e), 6).alias("low"), F.round(F.max(e), 6).alias("high"))


def check_arms(df: DataFrame, t: str = "t", y: str = "y", least: int = 30, least_outcomes: int = 5) -> None:
    """Each arm has to have `least` rows, and `least_outcomes` of either outcome."""
    cells = {(r[0], r[1]): r[2] for r in arms(df, t, y).collect()}
    for k in (0, 1):
        n = [cells.get((k, v), 0) for v in (0, 1)]
        if sum(n) < least or min(n) < least_outcomes:
            raise ValueError(f"arm {k} has {sum(n)} rows, outcomes 0 and 1: {n}; needed are {least} rows and {least_outcomes} of each outcome")


def joint_split(df: DataFrame, key: str, t: str = "t", y: str = "y", test: float = 0.3, seed: int = 7) -> DataFrame:
    """df with split: round(rows * test) rows of each cell of treatment and outcome are 'test'."""
    return sampling.split(df, key, [t, y], test, seed)


def propensity(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], t: str = "t") -> DataFrame:
    """df with e: a logistic regression on imputed, standardised numbers and one-hot categories, kept off 0 and 1."""
    seen = df.select(t, *numeric, *categorical).persist()  # what is fitted to is made once, however many passes there are
    x = features.encoded(seen, numeric, categorical)
    out = models.with_probability(seen, df, t, "e", x, l1=0.0, l2=1.0).withColumn("e", F.least(F.greatest("e", F.lit(1e-6)), F.lit(1 - 1e-6)))
    seen.unpersist()
    return out


def t_learner(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], t: str = "t", y: str = "y", least: int = 30) -> DataFrame:
    """df with mu0, mu1 and cate: a model for each arm on a shared encoding."""
    seen = df.select(t, y, *numeric, *categorical).persist()
    sizes = {r[0]: r[1] for r in seen.groupBy(t).count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < least:
        seen.unpersist()
        raise ValueError(f"each arm needs at least {least} rows; there are {sizes}")
    x = features.encoded(seen, numeric, categorical)
    for k in (0, 1):
        df = models.with_probability(seen.where(F.col(t) == k), df, y, f"mu{k}", x)
    seen.unpersist()
    return df.withColumn("cate", F.col("mu1") - F.col("mu0"))
