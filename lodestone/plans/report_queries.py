"""Queries on samples, tables for readers, metrics of several classes and calibrators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import binning, causal, drift, metrics, mining, profile, sampling, statistics
from lodestone.operators.classifier import PatternClassifier
from lodestone.plans import quality_queries
from lodestone.plans.extra_queries import CMP, comparison
from lodestone.plans.mining_queries import THREE, l1_sql
from lodestone.plans.quality_queries import EVENTS, PRED, S, T, drifted, scored, treat
from lodestone.sources.frames import FRAMES, frame, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Samples and splits
DRAWN = "row_number() OVER (PARTITION BY {strata} ORDER BY md5({key} || ':{seed}'), {key}) AS r, count(*) OVER (PARTITION BY {strata}) AS n"
add("stratified_sample", lambda s, d: sampling.stratified_sample(table(s, d, "orders"), "o_orderkey", "o_orderstatus", 0.1).select("o_orderkey", "o_orderstatus"),
    f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, {DRAWN.format(strata='o_orderstatus', key='o_orderkey', seed=0)} FROM orders) WHERE r <= greatest(1, ceil(round(n * 0.1, 9)))")
add("row_limit", lambda s, d: sampling.limit_rows(table(s, d, "orders"), "o_orderkey", 500, "o_orderstatus").select("o_orderkey", "o_orderstatus"),
    f"""WITH d AS (SELECT o_orderkey, o_orderstatus, {DRAWN.format(strata='o_orderstatus', key='o_orderkey', seed=0)}, count(*) OVER () AS t FROM orders),
q AS (SELECT o_orderstatus, any_value(n) * 500 // any_value(t) AS q, row_number() OVER (ORDER BY any_value(n) * 500 % any_value(t) DESC, o_orderstatus) AS k FROM d GROUP BY o_orderstatus),
u AS (SELECT o_orderstatus, q + CASE WHEN k <= 500 - sum(q) OVER () THEN 1 ELSE 0 END AS q FROM q) SELECT o_orderkey, o_orderstatus FROM d JOIN u USING (o_orderstatus) WHERE t <= 500 OR r <= q""")
add("joint_split", lambda s, d: causal.joint_split(treat(s, d), "o_orderkey").select("o_orderkey", "t", "y", "split"),
    f"WITH {T} SELECT o_orderkey, t, y, CASE WHEN r <= floor(round(n * 0.3, 9) + 0.5) THEN 'test' ELSE 'train' END AS split FROM (SELECT *, {DRAWN.format(strata='t, y', key='o_orderkey', seed=7)} FROM f)")
add("cross_folds", lambda s, d: sampling.folds(table(s, d, "orders"), "o_orderkey").groupBy("fold", "validation").agg(F.count("*").alias("n")),
    "WITH f AS (SELECT CAST(CAST('0x' || substr(md5(o_orderkey || ':0'), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM orders) SELECT fold, (fold + 1) % 5 AS validation, count(*) AS n FROM f GROUP BY fold")
add("keep_first", lambda s, d: sampling.keep_first(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_orderkey"], ["l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) = 1")
add("leak_check", lambda s, d: sampling.shared_keys(table(s, d, "lineitem").where("l_discount <= 0.02"), table(s, d, "lineitem").where("l_discount > 0.02"), "l_orderkey"),
    "SELECT count(*) AS shared FROM (SELECT l_orderkey FROM lineitem WHERE l_discount <= 0.02 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_discount > 0.02)")

# Tables for readers
add("pivot", lambda s, d: profile.pivot(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "max").withColumnsRenamed({v: f"status_{v}" for v in "FOP"}),
    "SELECT o_orderpriority, " + ", ".join(f"round(max(o_totalprice) FILTER (o_orderstatus = '{v}'), 6) AS status_{v}" for v in "FOP") + " FROM orders GROUP BY 1")
add("crosstab", lambda s, d: profile.crosstab(table(s, d, "orders"), "o_orderpriority", "o_orderstatus"),
    "SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
add("target_associations", lambda s, d: profile.target_associations(table(s, d, "lineitem"), "l_returnflag", NUMBERS, ("l_linestatus",)),
    f"""WITH x AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, l_returnflag AS t, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in NUMBERS)}),
g AS (SELECT col, t, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY ALL), a AS (SELECT col, avg(x) AS m FROM x GROUP BY col),
e AS (SELECT col, 'eta' AS measure, sqrt(sum(n * (g.m - a.m) ** 2) / (sum(n * (g.m - a.m) ** 2) + sum(n * v))) AS strength FROM g JOIN a USING (col) GROUP BY col),
c AS (SELECT l_linestatus AS a, l_returnflag AS b, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
r AS (SELECT sum(n * n / (na * nb)) AS s, any_value(t) AS t, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM w), p AS (SELECT r, k, t, greatest(s - 1 - (k - 1) * (r - 1) / (t - 1), 0) AS phi FROM r),
v AS (SELECT 'l_linestatus' AS col, 'cramers_v' AS measure, CASE WHEN least(r, k) >= 2 THEN sqrt(phi / (least(k - (k - 1) ** 2 / (t - 1), r - (r - 1) ** 2 / (t - 1)) - 1)) ELSE 0 END AS strength FROM p)
SELECT col, measure, round(strength, 6) AS strength FROM (FROM e UNION ALL FROM v)""")
add("dataset_summary", lambda s, d: profile.dataset_summary(table(s, d, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(3)) != 0, F.col("o_totalprice")).alias("price"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"))),
    "SELECT count(*) AS rows, 4 AS columns, count(*) + count(*) FILTER (o_orderkey % 3 = 0) AS missing_cells, round(100 * (count(*) + count(*) FILTER (o_orderkey % 3 = 0)) / (4 * count(*)), 6) AS missing_pct, 1 AS all_missing, 1 AS constant FROM orders")
add("profile_findings", lambda s, d: profile.findings(table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.lit("x").alias("one")), id_column="c_custkey").select("level", "title"),
    "SELECT * FROM (VALUES ('warning', 'segment'), ('warning', 'one')) AS t(level, title)")
add("lag_feature", lambda s, d: lag_feature(table(s, d, "events")), """SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag_1 FROM events""")


def lag_feature(events: DataFrame) -> DataFrame:
    from lodestone.operators.features import lags

    return lags(events, "user_id", ["ts", "event_id"], ["value"], [1]).select("event_id", "value_lag_1")


# Metrics
add("average_precision", lambda s, d: metrics.average_precision(scored(s, d)), f"""WITH {S}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p),
c AS (SELECT pos, sum(pos) OVER () AS t, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM g) SELECT round(sum(pos / t * tp / k), 6) AS average_precision FROM c""")
#: Three weights of a row, scaled to sum to 1, for the frame of three classes.
WEIGHTS = "SELECT label, abs(l_quantity - 15) + 5 * label + 1 AS a, abs(l_quantity - 25) + 100 * l_discount + 1 AS b, abs(l_quantity - 35) + 100 * l_tax + 1 AS c FROM f"
THIRDS = "SELECT label, round(a / (a + b + c), 6) AS p_0, round(b / (a + b + c), 6) AS p_1, round(c / (a + b + c), 6) AS p_2 FROM w"


def thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame(spark, sf_dir, "multi3").createOrReplaceTempView("f")
    spark.sql(WEIGHTS).createOrReplaceTempView("w")
    return spark.sql(THIRDS)


add("multiclass_metrics", lambda s, d: metrics.multiclass(thirds(s, d), (0, 1, 2)), f"""WITH f AS ({FRAMES['multi3']}), w AS ({WEIGHTS}), p AS ({THIRDS}),
h AS (SELECT *, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS g, CASE label WHEN 0 THEN p_0 WHEN 1 THEN p_1 ELSE p_2 END AS own FROM p),
k AS (SELECT k, (SELECT count(*) FROM h WHERE label = k AND g = k) AS t, (SELECT count(*) FROM h WHERE label = k) AS a, (SELECT count(*) FROM h WHERE g = k) AS g FROM range(3) AS r(k)),
l AS (SELECT 0 AS k, p_0 AS s, CAST(label = 0 AS INT) AS y FROM p UNION ALL SELECT 1, p_1, CAST(label = 1 AS INT) FROM p UNION ALL SELECT 2, p_2, CAST(label = 2 AS INT) FROM p),
r AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2 AS r FROM l),
u AS (SELECT k, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY k),
c AS (SELECT k, s, sum(y) AS pos, count(*) AS n FROM l GROUP BY k, s), d AS (SELECT k, pos, sum(pos) OVER (PARTITION BY k) AS t, sum(pos) OVER (PARTITION BY k ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY k ORDER BY s DESC) AS j FROM c),
m AS (SELECT k, sum(pos / t * tp / j) AS ap FROM d GROUP BY k)
SELECT round(avg(CAST(label = g AS INT)), 6) AS accuracy, (SELECT round(avg(t / a), 6) FROM k WHERE a > 0) AS balanced_accuracy, (SELECT round(avg(coalesce(2 * t / nullif(a + g, 0), 0)), 6) FROM k) AS macro_f1, round(-avg(ln(greatest(own, 1e-15))), 6) AS log_loss,
round(avg((p_0 - CAST(label = 0 AS INT)) ** 2 + (p_1 - CAST(label = 1 AS INT)) ** 2 + (p_2 - CAST(label = 2 AS INT)) ** 2), 6) AS brier, (SELECT round(avg(auc), 6) FROM u) AS auc_ovr, (SELECT round(avg(ap), 6) FROM m) AS average_precision FROM h""")


def activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "score_hi")
    fit = mining.prepare(df, binning.fit_fixed(df, THREE, 5))
    found = mining.mine(fit, 10, 1, 1e-3)
    return metrics.activation(mining.pattern_columns(df, fit), [p.name for p in found])


add("pattern_activation", activation, f"SELECT pattern, CAST(support AS BIGINT) AS active, round(support / (SELECT count(*) FROM lineitem), 6) AS rate FROM ({l1_sql('score_hi', THREE, 5, 10, 1e-3)})")
add("drift_summary", lambda s, d: drift.summary(drifted(s, d), ["value"]), f"SELECT round(psi, 5) AS psi, round(kl, 5) AS kl, CAST(psi > 0.1 AS BIGINT) AS drifted, severity FROM ({quality_queries.SQL['drift_psi_kl']})")
add("leaderboard", lambda s, d: statistics.leaderboard(comparison(s, d)), f"""WITH {CMP}, r AS (SELECT model, value, rank() OVER (PARTITION BY dataset ORDER BY value DESC) AS k, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS r FROM v)
SELECT model, count(*) AS datasets, round(avg(value), 6) AS mean, round(avg(r), 6) AS rank, count(*) FILTER (k = 1) AS firsts FROM r GROUP BY model""")


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    treat(spark, sf_dir).createOrReplaceTempView("f")
    return causal.overlap(spark.sql(PRED))


add("propensity_overlap", overlap, f"WITH {T}, p AS ({PRED}) SELECT t, count(*) AS n, round(avg(CAST(e >= 0.05 AND e <= 0.95 AS INT)), 6) AS overlap, round(avg(e), 6) AS mean, round(min(e), 6) AS low, round(max(e), 6) AS high FROM p GROUP BY t")


# Calibrators. The logistic one is held to its score equations, the isotonic one to the largest least mean of runs that hold a score.
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).where("p > 0.001 AND p < 0.999")
    z = F.ln(F.col("p") / (1 - F.col("p")))
    return metrics.calibrate_sigmoid(df, df).agg(F.round(F.avg("calibrated"), 3).alias("mean"), F.round(F.avg(z * F.col("calibrated")), 3).alias("moment"))


add("calibrate_sigmoid", sigmoid, f"WITH {S} SELECT round(avg(y), 3) AS mean, round(avg(y * ln(p / (1 - p))), 3) AS moment FROM s WHERE p > 0.001 AND p < 0.999")


def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "xor2").select(F.floor("l_quantity").alias("p"), F.col("label").alias("y"))
    return metrics.calibrate_isotonic(df, df).groupBy(F.col("p").cast("long").alias("p")).agg(F.count("*").alias("n"), F.round(F.avg("calibrated"), 6).alias("calibrated"))


add("calibrate_isotonic", isotonic, f"""WITH f AS ({FRAMES['xor2']}), g AS (SELECT CAST(floor(l_quantity) AS BIGINT) AS p, count(*) AS n, sum(label) AS y FROM f GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY p) AS cn, sum(y) OVER (ORDER BY p) AS cy FROM g),
m AS (SELECT x.p, x.n, a.p AS a, min((b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)) AS v FROM c x JOIN c a ON a.p <= x.p JOIN c b ON b.p >= x.p GROUP BY x.p, x.n, a.p) SELECT p, n, round(max(v), 6) AS calibrated FROM m GROUP BY p, n""")


# The model as a whole: fitted on four folds, held to the fifth.
def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "scored").select("l_orderkey", "l_returnflag", F.col("y").alias("label"))
    df = sampling.folds(df.join(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("quantity"), F.max("l_discount").alias("discount")), "l_orderkey"), "l_orderkey")
    model = PatternClassifier(["quantity", "discount", "l_returnflag"], length=2, top=20, mode="original_plus_patterns", budget=15).fit(df.where("fold <> 0"))
    return metrics.performance(model.predict_proba(df.where("fold = 0")), "label", "p_1").select("accuracy", "balanced_accuracy", "f1", "log_loss", "brier")


add("classifier_held_out", held_out)


def saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier with an indicator for every bin and next to no penalty says of each bin: the bin's own share."""
    df = frame(spark, sf_dir, "score_cat")
    model = PatternClassifier(["l_returnflag"], mode="original_plus_patterns", c=1e9).fit(df)
    return model.predict_proba(df).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("p_1"), 3).alias("p"))


add("classifier_saturated", saturated, f"WITH f AS ({FRAMES['score_cat']}) SELECT l_returnflag, count(*) AS n, round(avg(label), 3) AS p FROM f GROUP BY 1")
