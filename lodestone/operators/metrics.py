"""Quality of scores: calibration, ranking, thresholds, groups, patterns. Each is a few partial aggregations over (label, probability)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.quantiles import percentiles


def uniform_bin(p: Column, bins: int = 10, closed: bool = True) -> Column:
    """Number of the equal-width bin of [0, 1] that p falls in; the last is closed above unless told otherwise."""
    edges = [k / bins for k in range(1, bins)]
    k = sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return k if closed else F.when(p < 1, k)


def edge_bin(p: Column, edges: Sequence[float]) -> Column:
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))


def quantile_edges(df: DataFrame, p: str, bins: int = 10) -> list[float]:
    q = percentiles(df, {p: F.col(p)}, [k / bins for k in range(bins + 1)])[p]
    return sorted(set(q))


def reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """bin, n, confidence and accuracy of each bin that has rows."""
    k = uniform_bin(F.col(p), bins) if strategy == "uniform" else edge_bin(F.col(p), quantile_edges(df, p, bins))
    return df.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("accuracy"))


def calibration(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """One row: ece, mce, brier, and Murphy's reliability, resolution and uncertainty (over 10 uniform bins)."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    total = F.sum("n")
    ece = reliability(df, y, p, bins, strategy).agg((F.sum(F.col("n") * gap) / total).alias("ece"), F.max(gap).alias("mce"))
    cells = reliability(df, y, p, 10)
    base = df.agg(F.avg(y).alias("base"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
    parts = cells.crossJoin(F.broadcast(base)).agg(  # both sides have a fixed number of rows: ten bins and one
        F.first("brier").alias("brier"),
        (F.sum(F.col("n") * (F.col("confidence") - F.col("accuracy")) ** 2) / total).alias("reliability"),
        (F.sum(F.col("n") * (F.col("accuracy") - F.col("base")) ** 2) / total).alias("resolution"),
        F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )
    return ece.crossJoin(parts).select(*(F.round(c, 6).alias(c) for c in ("ece", "mce", "brier", "reliability", "resolution", "uncertainty")))


def auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Rank AUC with average ranks of ties: one row, auc (null with one class). Rows are counted by score before anything is ordered."""
    by = df.groupBy(F.col(p).alias("s")).agg(F.sum(y).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    # Negatives below a score: totals of coarse buckets, then running sums within a bucket, so that no task holds all scores.
    bucket = F.floor(F.col("s") * 4096)
    by = by.withColumn("b", bucket)
    coarse = by.groupBy("b").agg(F.sum("neg").alias("bn"))
    below = coarse.select("b", (F.sum("bn").over(Window.partitionBy(F.lit(0)).orderBy("b")) - F.col("bn")).alias("under"))
    inside = F.sum("neg").over(Window.partitionBy("b").orderBy("s")) - F.col("neg")
    wins = by.select("b", "pos", "neg", inside.alias("inside")).join(below, "b").select("pos", "neg", (F.col("pos") * (F.col("under") + F.col("inside") + F.col("neg") / 2)).alias("w"))
    return wins.agg(F.round(F.try_divide(F.sum("w"), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def threshold_sweep(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts and rates at thresholds 0, 0.05 to 1. Rows are first counted by the thresholds that they reach."""
    steps = [round(0.05 * k, 2) for k in range(21)]
    reached = sum((F.when(F.col(p) >= t, 1).otherwise(0) for t in steps), F.lit(0))
    cells = df.groupBy(reached.alias("r")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))
    tried = cells.select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("k", "threshold"))
    hit = F.col("r") > F.col("k")
    s = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0)).cast("long")
    out = tried.groupBy("threshold").agg(s(hit, "pos").alias("tp"), s(hit, "neg").alias("fp"), s(~hit, "neg").alias("tn"), s(~hit, "pos").alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return out.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"), rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), rate(tp + fp, tp + fp + tn + fn).alias("positive_rate"))


def separation(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Histogram of scores in 20 bins for each class."""
    return df.groupBy(uniform_bin(F.col(p), 20).alias("bin")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("positive"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("negative"))


def performance(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, balanced accuracy, F1, log loss, Brier score, confusion counts."""
    pred = (F.col(p) >= threshold).cast("int")
    n = lambda a, b: F.sum(((F.col(y) == a) & (pred == b)).cast("int"))
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    r = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"), loss.alias("log_loss"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return r.select("tp", "fp", "tn", "fn", F.round((tp + tn) / (tp + fp + tn + fn), 6).alias("accuracy"), F.round((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


def fairness(df: DataFrame, sensitive: Sequence[str], p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Rows, positive rate and mean probability for each value of each sensitive column."""
    values = F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("value")) for c in sensitive))
    return df.select(F.explode(values).alias("v"), p).groupBy("v.feature", "v.value").agg(F.count("*").alias("n"), F.round(F.avg((F.col(p) >= threshold).cast("int")), 6).alias("positive_rate"), F.round(F.avg(p), 6).alias("mean_probability"))


def coverage(matrix: DataFrame, patterns: int) -> DataFrame:
    """One row on the columns p0, p1, ...: shares of rows with at least 1, 5 and 10 patterns, mean active patterns, overlap, dead patterns."""
    active = sum((F.col(f"p{k}") for k in range(patterns)), F.lit(0))
    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in range(patterns)]
    share = lambda n: F.round(F.avg((F.col("a") >= n).cast("int")), 6)
    r = matrix.select("*", active.alias("a")).agg(share(1).alias("covered_1"), share(5).alias("covered_5"), share(10).alias("covered_10"), F.round(F.avg("a"), 6).alias("mean_active"), share(2).alias("overlap"), *sums)
    dead = sum((F.when(F.col(f"s{k}") == 0, 1).otherwise(0) for k in range(patterns)), F.lit(0))
    return r.select("covered_1", "covered_5", "covered_10", "mean_active", "overlap", dead.cast("long").alias("dead"))


def bands(df: DataFrame, p: str = "p") -> DataFrame:
    """Rows and share of each of five bands of probability, empty ones included."""
    names = ["[0.0, 0.2)", "[0.2, 0.4)", "[0.4, 0.6)", "[0.6, 0.8)", "[0.8, 1.0]"]
    r = df.agg(F.count("*").alias("n"), *(F.sum((uniform_bin(F.col(p), 5) == k).cast("int")).alias(f"b{k}") for k in range(5)))
    rows = F.array(*(F.struct(F.lit(v).alias("band"), F.col(f"b{k}").alias("cases"), F.round(F.col(f"b{k}") / F.col("n"), 6).alias("share")) for k, v in enumerate(names)))
    return r.select(F.explode(rows).alias("x")).select("x.*")


def cumulative_share(importance: DataFrame, by: Sequence[str] = ("weight",)) -> DataFrame:
    """Running share of absolute weight, largest first; the table is one of features, so it is small."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.abs(by[0]).desc(), "feature")
    return importance.select("*", F.round(F.sum(F.abs(by[0])).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(F.abs(by[0])).over(Window.partitionBy(F.lit(0))), 6).alias("cumulative"))


def _above(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """cells (by, s, pos, n) with above_pos and above_n, the sums over higher scores: totals of score ranges, then sums within one."""
    cells = cells.withColumn("b", F.floor(F.col("s") * 4096))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    coarse = cells.groupBy(*by, "b").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    over = coarse.select(*by, "b", *((F.sum(c).over(w.orderBy(F.desc("b"))) - F.col(c)).alias(f"o{c}") for c in ("bp", "bn")))
    i = Window.partitionBy(*by, "b").orderBy(F.desc("s"))
    own = cells.select("*", *((F.sum(c).over(i) - F.col(c)).alias(f"i_{c}") for c in ("pos", "n")))
    return own.join(over, [*by, "b"]).select(*by, "s", "pos", "n", (F.col("obp") + F.col("i_pos")).alias("above_pos"), (F.col("obn") + F.col("i_n")).alias("above_n"))


def _ranking(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """auc (ties count half) and average precision of each group."""
    neg = F.col("n") - F.col("pos")
    total, others = F.sum("pos"), F.sum(neg)
    return _above(cells, by).groupBy(*by).agg(
        F.try_divide(F.sum(neg * (F.col("above_pos") + F.col("pos") / 2)), total * others).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * (F.col("above_pos") + F.col("pos")) / (F.col("above_n") + F.col("n"))), total).alias("ap"),
    )


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: the precision at each score, weighted by the recall that it adds; rows of one score come together."""
    cells = df.groupBy(F.col(p).alias("s")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    return _ranking(cells, []).select(F.round("ap", 6).alias("average_precision"))


def multiclass(df: DataFrame, classes: Sequence[int], label: str = "label", prefix: str = "p_") -> DataFrame:
    """One row on the columns p_<class>: accuracy, balanced accuracy, macro F1, log loss, Brier score, and means over classes of one-against-rest
    AUC and average precision. The smallest class wins ties; a class without rows counts in no mean but that of F1, as 0."""
    best = F.greatest(*(F.col(f"{prefix}{k}") for k in classes))
    pred = F.lit(None).cast("int")
    for k in reversed(classes):
        pred = F.when(F.col(f"{prefix}{k}") == best, k).otherwise(pred)
    own = sum((F.when(F.col(label) == k, F.col(f"{prefix}{k}")).otherwise(0.0) for k in classes), F.lit(0.0))
    loss = -F.avg(F.ln(F.greatest(own, F.lit(1e-15))))
    brier = F.avg(sum(((F.col(f"{prefix}{k}") - (F.col(label) == k).cast("int")) ** 2 for k in classes), F.lit(0.0)))
    d = df.withColumn("_pred", pred)
    counts = [F.sum(((F.col(label) == k) & (F.col("_pred") == k)).cast("long")).alias(f"t{k}") for k in classes]
    counts += [F.sum((F.col(label) == k).cast("long")).alias(f"a{k}") for k in classes] + [F.sum((F.col("_pred") == k).cast("long")).alias(f"g{k}") for k in classes]
    flat = d.agg(F.count("*").alias("n"), loss.alias("log_loss"), brier.alias("brier"), *counts)
    hits = sum((F.col(f"t{k}") for k in classes), F.lit(0))
    recalls = F.array_compact(F.array(*(F.try_divide(f"t{k}", f"a{k}") for k in classes)))
    f1 = sum((F.coalesce(F.try_divide(2 * F.col(f"t{k}"), F.col(f"a{k}") + F.col(f"g{k}")), F.lit(0.0)) for k in classes), F.lit(0.0)) / len(classes)
    one = flat.select(F.round(hits / F.col("n"), 6).alias("accuracy"), F.round(F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x) / F.size(recalls), 6).alias("balanced_accuracy"), F.round(f1, 6).alias("macro_f1"), F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))
    each = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"{prefix}{k}").alias("s"), (F.col(label) == k).cast("long").alias("y")) for k in classes))).alias("v"))
    cells = each.groupBy("v.k", "v.s").agg(F.sum("v.y").alias("pos"), F.count("*").alias("n"))
    rank = _ranking(cells, ["k"]).agg(F.round(F.avg("auc"), 6).alias("auc_ovr"), F.round(F.avg("ap"), 6).alias("average_precision"))
    return one.crossJoin(F.broadcast(rank))  # one row on each side


def activation(matrix: DataFrame, names: Sequence[str], top: int = 25) -> DataFrame:
    """pattern, active rows and rate of the patterns p0, p1, ... that most rows have."""
    flat = matrix.agg(F.count("*").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(len(names))))
    rows = F.array(*(F.struct(F.lit(v).alias("pattern"), F.col(f"p{k}").alias("active"), F.round(F.col(f"p{k}") / F.col("n"), 6).alias("rate")) for k, v in enumerate(names)))
    return flat.select(F.explode(rows).alias("x")).select("x.*").orderBy(F.desc("active"), "pattern").limit(top)


def calibrate_sigmoid(train: DataFrame, df: DataFrame, y: str = "y", p: str = "p", out: str = "calibrated") -> DataFrame:
    """df with a probability that is logistic in the log-odds of p, fitted on train without a penalty."""
    from lodestone.operators.models import fit_logistic, logistic

    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.ln(q / (1 - q))
    b, (w,) = fit_logistic(train, y, [odds], l1=0.0)
    return df.withColumn(out, logistic(F.lit(b) + w * odds))


def calibrate_isotonic(train: DataFrame, df: DataFrame, y: str = "y", p: str = "p", out: str = "calibrated") -> DataFrame:
    """df with the monotone function of p nearest to the labels of train, linear between its steps. Rows are counted by score before the fit."""
    from pyspark.ml.regression import IsotonicRegression

    cells = train.groupBy(F.col(p).cast("double").alias("_s")).agg(F.avg(y).alias("_y"), F.count("*").cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w", predictionCol=out).fit(cells)
    return model.transform(df.withColumn("_s", F.col(p).cast("double"))).drop("_s")
