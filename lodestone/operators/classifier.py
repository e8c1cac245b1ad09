"""The model as a whole: bins, patterns, other features and weights, fitted once and then a projection over any rows, streams included.

Fitting sees the rows in aggregations; what is kept are numbers and strings, so a fitted model is saved as JSON and scoring needs no Spark ML.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.information import finite, gain_bits
from lodestone.operators import binning, features, mining, models, pairs
from lodestone.operators.binning import ColumnBins
from lodestone.operators.mining import Fit, Item, Pattern
from lodestone.operators.quantiles import percentiles

MODES = ("patterns_only", "original_plus_patterns", "original_plus_interactions")
#: Levels of a category that become features; a column with more of them gives none, its patterns aside.
MOST_LEVELS = 20


@dataclass
class Feature:
    """block is orig, pattern or augmented_pair; what the column is follows from kind and its arguments."""

    block: str
    name: str
    kind: str
    args: dict
    sources: list[str]
    ig: float = 0.0
    kept: bool = True

    @property
    def full_name(self) -> str:
        return f"{self.block}:{self.name}"

    @property
    def indicator(self) -> bool:
        return self.kind in ("level", "pattern")


@dataclass
class PatternClassifier:
    """Settings, and after `fit` what was learnt.

    mode: patterns alone, original columns and patterns, or original columns and patterns of two and more items. original_top keeps that many original
    features by gain. budget keeps that many features of all blocks together by gain (the earlier one wins ties). pair_top adds
    that many derived features of pairs of numbers. c is the inverse strength of the L1 penalty.
    """

    columns: list[str]
    label: str = "label"
    bins: int = 5
    adaptive: bool = False
    length: int = 1
    top: int = 10
    least_gain: float = 1e-3
    mode: str = "patterns_only"
    original_top: int | None = None
    budget: int | None = None
    pair_top: int = 0
    c: float = 1.0
    mined: Fit | None = None
    features: list[Feature] = field(default_factory=list)
    classes: list[int] = field(default_factory=list)
    weights: dict[int, list[float]] = field(default_factory=dict)
    prior: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}, not {self.mode}")
        if not self.columns or len(set(self.columns)) < len(self.columns) or self.label in self.columns:
            raise ValueError("columns have to be some, different, and without the label")
        for name in ("original_top", "budget"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} is at least 1")
        if self.c <= 0:
            raise ValueError("c is above 0")

    def fit(self, df: DataFrame) -> PatternClassifier:
        """Learn from the rows with a label. One class, or no feature, gives a model of constant shares."""
        df = df.where(F.col(self.label).isNotNull()).withColumn("label", F.col(self.label).cast("int"))
        made = binning.fit_adaptive(df, self.columns) if self.adaptive else binning.fit_fixed(df, self.columns, self.bins)
        self.mined = mining.prepare(df, made)
        self.classes = list(self.mined.classes)
        total = sum(self.mined.totals)
        if not total:
            raise ValueError("no rows with a label")
        self.prior = [n / total for n in self.mined.totals]
        mining.mine(self.mined, self.top, self.length, self.least_gain)
        self.mined.rows.unpersist()
        self.features = self._candidates(df)
        wide = self._wide(df, self.features).persist()
        self._score(wide)
        self._select()
        kept = [k for k, f in enumerate(self.features) if f.kept]
        self.weights = {}
        if kept and len(self.classes) > 1:
            told = self.classes[1:] if len(self.classes) == 2 else self.classes
            fitted = models.fit_all(wide, [F.col("label") == y for y in told], [f"f{k}" for k in kept], c=self.c)
            self.weights = {y: [b, *w] for y, (b, w) in zip(told, fitted, strict=True)}
        wide.unpersist()
        self.features = [self.features[k] for k in kept]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a column for each kept feature, named block:name."""
        coded = binning.apply_bins(df, self.mined.bins)
        return coded.select(*(F.col(f"`{c}`") for c in df.columns), *(self._column(f).alias(f.full_name) for f in self.features))

    def transform_patterns(self, df: DataFrame) -> DataFrame:
        """df with p0, p1, ... for the mined patterns, kept or not."""
        return mining.pattern_columns(df, self.mined).drop(*(f"code_{b.name}" for b in self.mined.bins))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with p_<class> for each class, and prediction, the class of the largest (of two: 1 from a half on; else the smaller in ties)."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns that the model was fitted on are missing: {missing}")
        coded = binning.apply_bins(df, self.mined.bins)
        own = [F.col(f"`{c}`") for c in df.columns]
        if not self.weights:
            scored = coded.select(*own, *(F.lit(p).alias(f"p_{y}") for y, p in zip(self.classes, self.prior, strict=True)))
        else:
            raw = {y: models.logistic(sum((F.lit(w) * self._column(f) for f, w in zip(self.features, v[1:], strict=True) if w), F.lit(v[0]))) for y, v in self.weights.items()}
            scored = coded.select(*own, *(p.alias(f"p_{y}") for y, p in raw.items()))
            if len(self.classes) == 2:
                no, yes = self.classes
                scored = scored.select(*own, (1 - F.col(f"p_{yes}")).alias(f"p_{no}"), f"p_{yes}")
            else:
                sums = sum((F.col(f"p_{y}") for y in self.classes), F.lit(0.0))
                scored = scored.select(*own, *((F.col(f"p_{y}") / sums).alias(f"p_{y}") for y in self.classes))
        if len(self.classes) == 2:
            return scored.withColumn("prediction", F.when(F.col(f"p_{self.classes[1]}") >= 0.5, self.classes[1]).otherwise(self.classes[0]))
        best, pred = F.array_max(F.array(*(F.col(f"p_{y}") for y in self.classes))), F.lit(None).cast("int")
        for y in reversed(self.classes):
            pred = F.when(F.col(f"p_{y}") == best, y).otherwise(pred)
        return scored.withColumn("prediction", pred)

    def importances(self, spark: SparkSession) -> DataFrame:
        """feature, sources, weight (mean of absolute weights over classes), ig, and a column weight_<class> for each fitted class; heaviest first."""
        rows = [(f.full_name, f.sources, round(sum(abs(v[k + 1]) for v in self.weights.values()) / max(1, len(self.weights)), 9), round(f.ig, 6), *(round(v[k + 1], 9) for v in self.weights.values())) for k, f in enumerate(self.features)]
        schema = "feature string, sources array<string>, weight double, ig double" + "".join(f", weight_{y} double" for y in self.weights)
        return spark.createDataFrame(sorted(rows, key=lambda r: (-r[2], r[0])), schema)

    def contributions(self, df: DataFrame) -> DataFrame:
        """df with a column contribution_<source> for each source column: its features' weights times how far they are from their means over df, shared evenly among the
        sources of a feature. For a linear margin with independent features these are the Shapley values. Of several classes: the last."""
        v = list(self.weights.values())[-1] if self.weights else [0.0] * (len(self.features) + 1)
        used = [(f, w) for f, w in zip(self.features, v[1:], strict=True) if w]
        coded = binning.apply_bins(df, self.mined.bins)
        means = coded.agg(F.lit(0).alias("none"), *(F.avg(self._column(f)).alias(f"m{k}") for k, (f, _) in enumerate(used))).first()
        by: dict[str, Column] = {c: F.lit(0.0) for c in self.columns}
        for k, (f, w) in enumerate(used):
            for s in f.sources:
                by[s] = by[s] + F.lit(w / len(f.sources)) * (self._column(f) - F.lit(means[f"m{k}"] or 0.0))
        return coded.select(*(F.col(f"`{c}`") for c in df.columns), *(x.alias(f"contribution_{c}") for c, x in by.items()))

    def without(self, names: Sequence[str]) -> PatternClassifier:
        """A model with the weights of the named features taken out; nothing is fitted anew."""
        keep = [k for k, f in enumerate(self.features) if f.full_name not in set(names)]
        return dataclasses.replace(self, features=[self.features[k] for k in keep], weights={y: [v[0], *(v[k + 1] for k in keep)] for y, v in self.weights.items()})

    def body(self) -> dict:
        """All of the model, for `sources.tables.save_body`."""
        own = {f.name: getattr(self, f.name) for f in dataclasses.fields(self) if f.name not in ("mined", "features", "weights")}
        m = self.mined
        items = {i.id: i for p in m.patterns for i in p.items}
        return own | {
            "features": [dataclasses.asdict(f) for f in self.features], "weights": {str(y): v for y, v in self.weights.items()},
            "bins": [dataclasses.asdict(b) for b in m.bins], "totals": m.totals, "items": {str(k): dataclasses.asdict(i) for k, i in items.items()},
            "patterns": [{"items": [i.id for i in p.items], "support": p.support, "utility": p.utility, "ig": p.ig} for p in m.patterns],
        }

    @classmethod
    def from_body(cls, body: dict) -> PatternClassifier:
        body = dict(body)
        items = {int(k): Item(**v) for k, v in body.pop("items").items()}
        patterns = [Pattern(tuple(items[i] for i in p["items"]), p["support"], p["utility"], p["ig"]) for p in body.pop("patterns")]
        bins = [ColumnBins(**b) for b in body.pop("bins")]
        made = [Feature(**f) for f in body.pop("features")]
        weights = {int(y): v for y, v in body.pop("weights").items()}
        mined = Fit(None, bins, list(items.values()), body.pop("totals"), body["classes"], patterns)
        return cls(mined=mined, features=made, weights=weights, **body)

    def _candidates(self, df: DataFrame) -> list[Feature]:
        numeric = [c for c in self.columns if binning.kind_of(df, c) != "cat"]
        out: list[Feature] = []
        if self.mode != "patterns_only":
            out += self._originals(df, numeric)
        for k, p in enumerate(self.mined.patterns):
            if self.mode != "original_plus_interactions" or len(p.items) > 1:
                out.append(Feature("pattern", p.name, "pattern", {"index": k}, sorted({i.col for i in p.items})))
        if self.pair_top and len(numeric) > 1:
            out += self._pairs(df, numeric)
        return out

    def _originals(self, df: DataFrame, numeric: list[str]) -> list[Feature]:
        out = []
        if numeric:
            med = [(q or [0.0])[0] for q in percentiles(df, {c: finite(c) for c in numeric}, (0.5,)).values()]
            full = [F.coalesce(finite(c), F.lit(m)) for c, m in zip(numeric, med, strict=True)]
            s = df.agg(*(f(x) for x in full for f in (F.avg, F.stddev_pop))).first()
            out += [Feature("orig", c, "number", {"column": c, "median": med[k], "mean": s[2 * k], "std": s[2 * k + 1] or 1.0}, [c]) for k, c in enumerate(numeric)]
        for c in (c for c in self.columns if c not in numeric):
            text = F.col(c).cast("string")
            levels = [r[0] for r in df.select(text.alias("v")).where("v is not null").distinct().limit(MOST_LEVELS + 1).collect()]
            if len(levels) <= MOST_LEVELS:
                out += [Feature("orig", f"{c}={v if v is not None else '<NA>'}", "level", {"column": c, "value": v}, [c]) for v in [*sorted(levels), None]]
        return out

    def _pairs(self, df: DataFrame, numeric: list[str]) -> list[Feature]:
        tried = [(r["a"], r["b"]) for r in pairs.interaction_information(df, numeric).limit(self.pair_top).collect()]
        by = {f"{a} {op} {b}": (a, op, b) for a, b in tried for op in pairs.OPERATIONS}
        best = [by[r["feature"]] for r in pairs.pair_scores(df, tried, top=self.pair_top).collect()]
        s = df.agg(F.lit(0), *(f(pairs.OPERATIONS[op](finite(a), finite(b))) for a, op, b in best for f in (F.avg, F.stddev_pop))).first()
        return [Feature("augmented_pair", f"{a} {op} {b}", "pair", {"a": a, "op": op, "b": b, "mean": s[2 * k + 1] or 0.0, "std": s[2 * k + 2] or 1.0}, [a, b]) for k, (a, op, b) in enumerate(best)]

    def _column(self, f: Feature) -> Column:
        """The feature as an expression over rows with codes."""
        a = f.args
        if f.kind == "number":
            return (F.coalesce(finite(a["column"]), F.lit(a["median"])) - a["mean"]) / a["std"]
        if f.kind == "level":
            return F.col(a["column"]).cast("string").eqNullSafe(F.lit(a["value"])).cast("double")
        if f.kind == "pair":
            return F.coalesce((pairs.OPERATIONS[a["op"]](finite(a["a"]), finite(a["b"])) - a["mean"]) / a["std"], F.lit(0.0))
        tests = [F.col(f"code_{i.col}") == i.code for i in self.mined.patterns[a["index"]].items]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit & t
        return F.coalesce(hit, F.lit(False)).cast("double")

    def _wide(self, df: DataFrame, made: list[Feature]) -> DataFrame:
        return binning.apply_bins(df, self.mined.bins).select("label", *(self._column(f).alias(f"f{k}") for k, f in enumerate(made)))

    def _score(self, wide: DataFrame) -> None:
        """Gain in bits of each feature: of a number cut at its quartiles, of an indicator as it is."""
        flags = [k for k, f in enumerate(self.features) if f.indicator]
        rest = [k for k, f in enumerate(self.features) if not f.indicator]
        if flags:
            rows = wide.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(f"f{k}").alias(f"f{k}") for k in flags)).collect()
            for k in flags:
                self.features[k].ig = gain_bits([[r[f"f{k}"] for r in rows], [r["n"] - r[f"f{k}"] for r in rows]], 1e-15)
        if rest:
            scored = {r["feature"]: r["ig"] for r in features.quartile_scores(wide, [f"f{k}" for k in rest]).collect()}
            for k in rest:
                self.features[k].ig = scored.get(f"f{k}", 0.0)

    def _select(self) -> None:
        def keep(of: list[int], most: int | None) -> None:
            best = set(sorted(of, key=lambda k: (-round(self.features[k].ig, 9), k))[:most])
            for k in of:
                self.features[k].kept = k in best

        if self.original_top is not None:
            keep([k for k, f in enumerate(self.features) if f.block == "orig"], self.original_top)
        if self.budget is not None:
            keep([k for k, f in enumerate(self.features) if f.kept], self.budget)
