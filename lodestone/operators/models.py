"""Logistic regressions in aggregations, tree models on Spark ML, and the sequential residual trees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Sums in an aggregation up to which a regression is fitted by Newton steps; a wider one goes to Spark ML. Steps at most.
MOST_SUMS, STEPS = 500, 50


def with_probability(train: DataFrame, df: DataFrame, label: str, out: str, features: Sequence[str | Column], l1: float = 1.0, l2: float = 0.0, c: float = 1.0) -> DataFrame:
    """df with the probability of label 1 by a logistic regression fitted on train; features are expressions over both.

    The penalty is that of `fit_logistic`. One class in train gives its share, a constant.
    """
    (p,) = probabilities(train, [F.col(label)], features, l1, l2, c)
    return df.withColumn(out, p)


def probabilities(train: DataFrame, labels: Sequence[Column], features: Sequence[str | Column], l1: float = 1.0, l2: float = 0.0, c: float = 1.0) -> list[Column]:
    """The probability of each label, by regressions fitted in the same passes, as an expression over the features."""
    return [logistic(margin(features, v)) if isinstance(v, tuple) else F.lit(v) for v in _fitted(train, labels, features, l1, l2, c)]


def margin(features: Sequence[str | Column], fitted: tuple[float, list[float]]) -> Column:
    return sum((F.lit(w) * (F.col(x) if isinstance(x, str) else x) for x, w in zip(features, fitted[1], strict=True) if w), F.lit(fitted[0]))


def fit_logistic(train: DataFrame, label: str, features: Sequence[str | Column], l1: float = 1.0, l2: float = 0.0, c: float = 1.0) -> tuple[float, list[float]]:
    """Intercept and weights of a logistic regression. The penalty is (l1 |w| + l2 w*w / 2) / (c * rows), on the features as they are; none if both
    are 0. One class in train gives its share as a constant, kept off 0 and 1."""
    return fit_all(train, [F.col(label)], features, l1, l2, c)[0]


def fit_all(train: DataFrame, labels: Sequence[Column], features: Sequence[str | Column], l1: float = 1.0, l2: float = 0.0, c: float = 1.0) -> list[tuple[float, list[float]]]:
    """fit_logistic for each of the labels, in the same passes."""
    out = []
    for v in _fitted(train, labels, features, l1, l2, c):
        share = v if isinstance(v, tuple) else min(1 - 1e-9, max(1e-9, v))
        out.append(v if isinstance(v, tuple) else (math.log(share / (1 - share)), [0.0] * len(features)))
    return out


def _fitted(train: DataFrame, labels: Sequence[Column], features: Sequence[str | Column], l1: float, l2: float, c: float) -> list[tuple[float, list[float]] | float]:
    """(intercept, weights) for each label, or its share if that is 0 or 1.

    Newton steps, on the loss's expansion with the penalty as it is (a proximal Newton method): a step is one aggregation of gradients and second derivatives for all labels, and six to
    ten of them do where a quasi-Newton method takes up to a hundred. train is read in each, so what is dear to make had better be persisted.
    """
    width, names = len(features), [f"_y{k}" for k in range(len(labels))]
    rows = train.select(*(y.cast("double").alias(n) for y, n in zip(labels, names, strict=True)), *((F.col(x) if isinstance(x, str) else x).cast("double").alias(f"_x{k}") for k, x in enumerate(features)))
    rows = rows.where(reduce(Column.__and__, (F.col(n).isNotNull() for n in names)))
    n, *means = rows.agg(F.count("*"), *(F.avg(y) for y in names)).first()
    out: list = [m or 0.0 for m in means]
    if (width + 1) * (width + 4) // 2 + 1 > MOST_SUMS:
        return [_by_spark(rows, y, width, l1, l2, c * n) if 0 < m < 1 else m for y, m in zip(names, out, strict=True)]
    at = {k: np.array([math.log(m / (1 - m))] + [0.0] * width) for k, m in enumerate(out) if 0 < m < 1}
    lasso, ridge = np.array([0.0] + [l1 / c] * width), np.array([0.0] + [l2 / c] * width)
    known: dict[int, tuple] = {}  # where each label's last step started, and the objective there
    first: dict[int, float] = {}
    group = max(1, MOST_SUMS // ((width + 1) * (width + 4) // 2 + 1))
    for _ in range(STEPS * max(1, -(-len(at) // group))):
        left = list(at)[:group] if len(at) > group else list(at)
        if not left:
            break
        for k, (loss, g, h) in _derivatives(rows, {k: (names[k], at[k]) for k in left}, width).items():
            w = at[k]
            value = loss + float(lasso @ abs(w) + ridge @ (w * w) / 2)
            first.setdefault(k, value)
            if k in known and value > known[k][1] + 1e-11 * abs(known[k][1]):
                if abs(w - known[k][0]).max() > 1e-12 * (1 + abs(w).max()):
                    at[k] = (w + known[k][0]) / 2  # too far
                    continue
                best = known[k][0]
                gain = 0.0
            else:
                known[k] = (w, value)
                best = _step(w, g, h, lasso, ridge)
                d = best - w
                gain = -float(g @ d + d @ h @ d / 2 + lasso @ (abs(best) - abs(w)) + ridge @ (best * best - w * w) / 2)
            at[k] = best
            if gain <= 1e-10 * first[k]:  # what is left after this step is about the square of it
                out[k] = (float(best[0]), [float(v) for v in best[1:]])
                del at[k], known[k]
    for k, (w, _) in known.items():
        out[k] = (float(w[0]), [float(v) for v in w[1:]])
    return out


def _derivatives(rows: DataFrame, at: dict[int, tuple[str, np.ndarray]], width: int) -> dict[int, tuple]:
    """For each label's weights the loss, its gradient and its second derivatives, of the intercept first."""
    x = [F.col(f"_x{k}") for k in range(width)]
    z = rows.select("*", *(sum((F.lit(float(v)) * x[j] for j, v in enumerate(w[1:]) if v), F.lit(float(w[0]))).alias(f"_z{k}") for k, (_, w) in at.items()))
    p = z.select("*", *(logistic(F.col(f"_z{k}")).alias(f"_p{k}") for k in at))
    sums = []
    for k, (y, _) in at.items():
        r, q, m = F.col(f"_p{k}") - F.col(y), F.col(f"_p{k}") * (1 - F.col(f"_p{k}")), F.col(f"_z{k}")
        sums += [F.sum(F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - F.col(y) * m), F.sum(r), *(F.sum(r * v) for v in x), F.sum(q), *(F.sum(q * v) for v in x), *(F.sum(q * x[i] * x[j]) for i in range(width) for j in range(i + 1))]
    flat, each = list(p.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()), len(sums) // len(at)
    out = {}
    for i, k in enumerate(at):
        v = flat[i * each : (i + 1) * each]
        h = np.zeros((width + 1, width + 1))
        h[0] = h[:, 0] = v[width + 2 : 2 * width + 3]
        h[1:, 1:][np.tril_indices(width)] = v[2 * width + 3 :]
        h[1:, 1:] += np.tril(h[1:, 1:], -1).T
        out[k] = (float(v[0]), np.array(v[1 : width + 2]), h)
    return out


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The weights that are best for the expansion at w with the penalty: by coordinates, which tells the weights that are 0, and by a linear system for the others, as far as no sign changes."""
    if not lasso.any():
        return w - np.linalg.lstsq(h + np.diag(ridge), g + ridge * w, rcond=1e-13)[0]
    v, r, scale = w.copy(), g.copy(), np.sqrt(np.diag(h) + ridge)
    for _ in range(rounds):
        for _ in range(10):
            most = 0.0
            for j in np.flatnonzero(scale > 1e-9 * scale.max()):
                s = scale[j] ** 2
                u = s * v[j] - r[j] - ridge[j] * v[j]
                new = math.copysign(max(abs(u) - lasso[j], 0.0), u) / s
                if (d := new - v[j]) != 0.0:
                    v[j] = new
                    r += h[:, j] * d
                    most = max(most, abs(d) * scale[j])
        if most <= 1e-11 * scale.max():
            break
        on = np.flatnonzero((v != 0) | (lasso == 0))
        d = np.linalg.lstsq(h[np.ix_(on, on)] + np.diag(ridge[on]), -(r + ridge * v + lasso * np.sign(v))[on], rcond=1e-13)[0]
        crossed = [(-v[k] / x, k) for k, x in zip(on, d, strict=True) if lasso[k] and v[k] * (v[k] + x) < 0]
        far, at = min(crossed, default=(1.0, None))
        v[on] += far * d
        r += h[:, on] @ (far * d)
        if at is not None:
            v[at] = 0.0
    return v


def _by_spark(rows: DataFrame, label: str, width: int, l1: float, l2: float, strength: float) -> tuple[float, list[float]]:
    penalty = {"elasticNetParam": l1 / (l1 + l2), "regParam": (l1 + l2) / strength} if l1 + l2 else {}
    model = LogisticRegression(labelCol=label, standardization=False, maxIter=100, **penalty).fit(vectors(rows, [f"_x{k}" for k in range(width)]))
    return float(model.intercept), [float(w) for w in model.coefficients]


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def vectors(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def one_vs_rest(train: DataFrame, df: DataFrame, label: str, classes: Sequence[int], features: Sequence[str | Column], c: float = 1.0) -> DataFrame:
    """df with p_<class>, one regression for each class, scaled to sum to 1."""
    p = probabilities(train, [F.col(label) == k for k in classes], features, c=c)
    df = df.withColumns({f"p_{k}": v for k, v in zip(classes, p, strict=True)})
    total = sum((F.col(f"p_{k}") for k in classes), F.lit(0.0))
    return df.withColumns({f"p_{k}": F.col(f"p_{k}") / total for k in classes})


def constant_prior(df: DataFrame, label: str = "label") -> DataFrame:
    """df with p, the share of label 1: the model for no patterns."""
    return df.withColumn("p", F.lit(df.agg(F.avg(label)).first()[0]))


def deviance(df: DataFrame, label: str, margin: str) -> float:
    """Mean binomial deviance of a margin."""
    z = F.least(F.greatest(F.col(margin), F.lit(-35.0)), F.lit(35.0))
    return df.agg(2 * F.avg(F.log1p(F.exp(z)) - F.col(label) * z)).first()[0]


def residual_trees(df: DataFrame, columns: Sequence[str], label: str = "label", rounds: int = 3, depth: int = 2, rate: float = 1.0) -> tuple[Column, list[float]]:
    """Newton-boosted trees: each is fitted to the sign of the residual, its leaves get sum(r) / (sum(w) + 1), and a step that
    doesn't lower the deviance is halved up to six times, then refused. Returns the margin as one expression and the deviance after each round.

    A round is a tree fit and two aggregations; the margin is a generated expression, so rows aren't materialised between rounds.
    """
    from pyspark.ml.classification import DecisionTreeClassifier

    prior = min(1 - 1e-6, max(1e-6, df.agg(F.avg(label)).first()[0]))
    margin: Column = F.log(F.lit(prior / (1 - prior)))
    data = vectors(df.na.drop(subset=list(columns)), columns).persist()
    loss = [deviance(data.withColumn("_z", margin), label, "_z")]
    for k in range(rounds):
        p = 1 / (1 + F.exp(-margin))
        now = data.withColumn("_p", p).withColumn("_sign", (F.col(label) > F.col("_p")).cast("double"))
        tree = DecisionTreeClassifier(labelCol="_sign", maxDepth=depth, maxBins=32, seed=1009 * k, probabilityCol="_tp", rawPredictionCol="_tr", predictionCol="_tc").fit(now)
        lines = tree.toDebugString.splitlines()[1:]
        leaf = _leaf(lines, columns, [0])
        sums = now.withColumn("_leaf", leaf).groupBy("_leaf").agg((F.sum(F.col(label) - F.col("_p")) / (F.sum(F.col("_p") * (1 - F.col("_p"))) + 1)).alias("v")).collect()
        value = F.lit(0.0)
        for r in sums:
            value = F.when(leaf == r["_leaf"], F.lit(r["v"])).otherwise(value)
        step = rate
        for _ in range(7):
            tried = margin + step * value
            d = deviance(data.withColumn("_z", tried), label, "_z")
            if d < loss[-1]:
                margin = tried
                loss.append(d)
                break
            step /= 2
        else:
            break
    data.unpersist()
    return margin, loss


def _leaf(lines: list[str], columns: Sequence[str], count: list[int]) -> Column:
    """A tree's printed form as the number of the leaf that a row reaches."""
    import re

    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        count[0] += 1
        return F.lit(count[0] - 1)
    feature, threshold = re.match(r"If \(feature (\d+) <= (.+)\)", line).groups()
    yes = _leaf(lines, columns, count)
    lines.pop(0)
    return F.when(F.col(columns[int(feature)]) <= float(threshold), yes).otherwise(_leaf(lines, columns, count))
