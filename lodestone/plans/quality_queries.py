"""Queries on metrics, drift, profiles, encodings and effects, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import binning, causal, drift, features, metrics, mining, profile
from lodestone.plans.mining_queries import THREE, long_sql
from lodestone.sources.frames import FRAMES, frame, split_by_order, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


S = f"s AS ({FRAMES['scored']})"
scored = lambda s, d: frame(s, d, "scored")
BIN = lambda n, p="p": " + ".join(f"CASE WHEN {p} >= {k / n!r} THEN 1 ELSE 0 END" for k in range(1, n))

add("reliability", lambda s, d: metrics.reliability(scored(s, d)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy")),
    f"WITH {S} SELECT {BIN(10)} AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM s GROUP BY 1")
add("reliability_quantile", lambda s, d: metrics.reliability(scored(s, d), strategy="quantile").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy")),
    f"WITH {S}, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [{', '.join(str(k / 10) for k in range(11))}]))) AS e FROM s) SELECT CAST(len(list_filter(e[2:len(e) - 1], lambda v: p >= v)) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM s, e GROUP BY 1")
add("calibration", lambda s, d: metrics.calibration(scored(s, d)), f"""WITH {S}, b AS (SELECT {BIN(10)} AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM s GROUP BY 1), t AS (SELECT avg(y) AS base, avg((p - y) ** 2) AS brier FROM s)
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, round(max(abs(c - a)), 6) AS mce, round(any_value(brier), 6) AS brier, round(sum(n * (c - a) ** 2) / sum(n), 6) AS reliability, round(sum(n * (a - base) ** 2) / sum(n), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM b, t""")
add("auc", lambda s, d: metrics.auc(scored(s, d)), f"""WITH {S}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s)
SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
add("threshold_sweep", lambda s, d: metrics.threshold_sweep(scored(s, d)), f"""WITH {S}, th AS (SELECT round(k * 0.05, 2)::DOUBLE AS threshold FROM range(21) AS r(k)),
c AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 0) AS tn, count(*) FILTER (p < threshold AND y = 1) AS fn FROM s, th GROUP BY threshold)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 6) END AS specificity, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp + fp) / (tp + fp + tn + fn), 6) AS positive_rate FROM c""")
add("score_separation", lambda s, d: metrics.separation(scored(s, d)), f"WITH {S} SELECT {BIN(20)} AS bin, CAST(sum(y) AS BIGINT) AS positive, CAST(sum(1 - y) AS BIGINT) AS negative FROM s GROUP BY 1")
add("performance", lambda s, d: metrics.performance(scored(s, d)), f"""WITH {S}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p < 0.5 AND y = 1) AS fn,
round(-avg(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier FROM s)
SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
add("fairness", lambda s, d: metrics.fairness(scored(s, d), ["l_returnflag", "l_linestatus"]), f"""WITH {S}, v AS (SELECT 'l_returnflag' AS feature, l_returnflag AS value, p FROM s UNION ALL SELECT 'l_linestatus', l_linestatus, p FROM s)
SELECT feature, value, count(*) AS n, round(avg(CAST(p >= 0.5 AS INT)), 6) AS positive_rate, round(avg(p), 6) AS mean_probability FROM v GROUP BY feature, value""")
add("probability_bands", lambda s, d: metrics.bands(scored(s, d)), f"""WITH {S}, b AS (SELECT unnest(range(5)) AS k, unnest(['[0.0, 0.2)', '[0.2, 0.4)', '[0.4, 0.6)', '[0.6, 0.8)', '[0.8, 1.0]']) AS band), c AS (SELECT {BIN(5)} AS k, count(*) AS n FROM s GROUP BY 1)
SELECT band, coalesce(n, 0) AS cases, round(coalesce(n, 0) / (SELECT count(*) FROM s), 6) AS share FROM b LEFT JOIN c USING (k)""")


def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "score_hi")
    fit = mining.prepare(df, binning.fit_fixed(df, THREE, 5))
    found = mining.mine(fit, 10, 1, 1e-3)
    return metrics.coverage(mining.pattern_columns(df, fit), len(found))


add("pattern_coverage", pattern_coverage)

# Drift: the first 70 % of events by time against the rest, with values scaled by 1.2 in the latter.
EVENTS = "ev AS (SELECT event_id, ts, event_type, value, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events), parts AS (SELECT event_type, CASE WHEN r <= greatest(1, least(n - 1, CAST(floor(n * 0.7) AS INT))) THEN 'reference' ELSE 'current' END AS part, value FROM ev), d AS (SELECT event_type, part, CASE WHEN part = 'current' THEN value * 1.2 ELSE value END AS value FROM parts)"


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_by_order(table(spark, sf_dir, "events"), ["ts", "event_id"])
    return split.withColumn("value", F.when(F.col("part") == "current", F.col("value") * 1.2).otherwise(F.col("value")))


add("drift_psi_kl", lambda s, d: drift.divergence(drifted(s, d), ["value"]), f"""WITH {EVENTS}, r AS (SELECT min(value) AS lo, max(value) - min(value) AS w FROM d WHERE part = 'reference'),
b AS (SELECT part, CAST(len(list_filter(range(1, 10), lambda k: value >= lo + w * k / 10)) AS INT) AS bin FROM d, r WHERE value BETWEEN lo AND lo + w),
c AS (SELECT k AS bin, (SELECT count(*) FROM b WHERE part = 'reference' AND bin = k) AS x, (SELECT count(*) FROM b WHERE part = 'current' AND bin = k) AS y FROM range(10) AS g(k)),
p AS (SELECT x / (sum(x) OVER () + 1e-6) + 1e-6 AS p, y / (sum(y) OVER () + 1e-6) + 1e-6 AS q FROM c), o AS (SELECT round(greatest(sum((q - p) * ln(q / p)), 0), 6) AS psi, round(sum(p * ln(p / q) + q * ln(q / p)) / 2, 6) AS kl FROM p)
SELECT 'value' AS col, psi, kl, CASE WHEN psi > 0.25 THEN 'significant' WHEN psi > 0.1 THEN 'moderate' ELSE 'none' END AS severity FROM o""")
add("drift_quantile_psi", lambda s, d: drift.quantile_psi(drifted(s, d), "value"), f"""WITH {EVENTS}, e AS (SELECT list_sort(list_distinct(quantile_cont(value, [{', '.join(str(k / 10) for k in range(11))}]))) AS e FROM d WHERE part = 'reference'),
b AS (SELECT part, len(list_filter(e[2:len(e) - 1], lambda v: value > v)) AS bin FROM d, e), c AS (SELECT bin, count(*) FILTER (part = 'reference') AS x, count(*) FILTER (part = 'current') AS y FROM b GROUP BY bin),
p AS (SELECT greatest(x / sum(x) OVER (), 1e-6) AS p, greatest(y / sum(y) OVER (), 1e-6) AS q FROM c) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""")
add("drift_ks", lambda s, d: drift.ks(drifted(s, d), "value"), f"""WITH {EVENTS}, c AS (SELECT value, count(*) FILTER (part = 'reference') AS x, count(*) FILTER (part = 'current') AS y FROM d GROUP BY value),
f AS (SELECT sum(x) OVER (ORDER BY value) / sum(x) OVER () AS a, sum(y) OVER (ORDER BY value) / sum(y) OVER () AS b FROM c) SELECT round(max(abs(a - b)), 6) AS ks FROM f""")
add("drift_tvd", lambda s, d: drift.total_variation(drifted(s, d), ["event_type"]), f"""WITH {EVENTS}, c AS (SELECT event_type, count(*) FILTER (part = 'reference') AS x, count(*) FILTER (part = 'current') AS y FROM d GROUP BY 1), p AS (SELECT abs(x / sum(x) OVER () - y / sum(y) OVER ()) AS g FROM c) SELECT 'event_type' AS col, round(sum(g) / 2, 6) AS tvd FROM p""")
add("drift_labels", lambda s, d: drift.label_drift(drifted(s, d), "event_type"), f"""WITH {EVENTS}, c AS (SELECT event_type AS label, count(*) FILTER (part = 'reference') AS x, count(*) FILTER (part = 'current') AS y FROM d GROUP BY 1) SELECT label, change FROM (SELECT label, x, round(y / sum(y) OVER () - x / sum(x) OVER (), 6) AS change FROM c) WHERE x > 0""")
add("monitor_daily", lambda s, d: drift.monitor(table(s, d, "events")), """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2""")

# Profiles
li = lambda s, d: table(s, d, "lineitem")


def profile_sql(columns: list[str]) -> str:
    one = lambda c: f"""(WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM f)
SELECT '{c}' AS col, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS low, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, round(max({c}), 6) AS high,
round(skewness({c}), 6) AS skewness, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negative, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM f, q)"""  # noqa: E731
    return " UNION ALL ".join(map(one, columns))


NUM = ["l_quantity", "l_extendedprice", "l_discount"]
add("profile_numeric", lambda s, d: profile.numeric_profile(table(s, d, "lineitem").withColumn("l_quantity", F.when(F.pmod("l_orderkey", F.lit(17)) != 0, F.col("l_quantity"))), NUM),
    f"WITH f AS (SELECT CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount FROM lineitem) {profile_sql(NUM)}")
add("profile_categorical", lambda s, d: profile.categorical_profile(li(s, d), ["l_returnflag", "l_linestatus"]), """WITH v AS (SELECT 'l_returnflag' AS col, l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem), c AS (SELECT col, value, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY col) AS t, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS k FROM c)
SELECT col, CAST(any_value(t) AS BIGINT) AS n, 0 AS missing, count(*) AS levels, max(value) FILTER (k = 1) AS mode, max(n) FILTER (k = 1) AS mode_count, count(*) FILTER (n < greatest(2, floor(t * 0.01))) AS rare, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM t GROUP BY col""")
add("profile_datetime", lambda s, d: profile.datetime_profile(table(s, d, "events"), "ts", "user_id").select("n", "distinct_values", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"), "span", "common_step"), """WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) AS BIGINT) AS step FROM events), c AS (SELECT step, count(*) AS k FROM s WHERE step IS NOT NULL GROUP BY step)
SELECT count(ts) AS n, count(DISTINCT ts) AS distinct_values, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS span, (SELECT step FROM c ORDER BY k DESC, step LIMIT 1) AS common_step FROM events""")
add("profile_text", lambda s, d: profile.text_profile(table(s, d, "documents"), "text"), "SELECT count(text) AS n, count(DISTINCT text) AS distinct_values, round(avg(length(text)), 6) AS mean_length, CAST(max(length(text)) AS INT) AS longest, count(*) FILTER (trim(text) = '') AS blank FROM documents")
add("missing_patterns", lambda s, d: profile.missing_patterns(table(s, d, "orders").select(F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.col("o_totalprice")).alias("price"), F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.col("o_orderstatus")).alias("status")), ["price", "status"]),
    "WITH f AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders), p AS (SELECT concat_ws(', ', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN status IS NULL THEN 'status' END) AS p FROM f) SELECT CASE WHEN p = '' THEN 'Complete' ELSE p END AS pattern, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM p GROUP BY 1")
add("cramers_v", lambda s, d: profile.cramers_v(li(s, d), "l_returnflag", "l_linestatus"), """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
r AS (SELECT sum(n * n / (na * nb)) AS s, any_value(t) AS t, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM w), x AS (SELECT r, k, t, greatest(s - 1 - (k - 1) * (r - 1) / (t - 1), 0) AS phi FROM r)
SELECT round(CASE WHEN least(r, k) >= 2 THEN sqrt(phi / (least(k - (k - 1) ** 2 / (t - 1), r - (r - 1) ** 2 / (t - 1)) - 1)) ELSE 0 END, 6) AS v FROM x""")
add("correlation_ratio", lambda s, d: profile.correlation_ratio(li(s, d), "l_returnflag", "l_extendedprice"), "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1), t AS (SELECT n, v, n * (m - sum(n * m) OVER () / sum(n) OVER ()) ** 2 AS b FROM g) SELECT round(sqrt(sum(b) / (sum(b) + sum(n * v))), 6) AS eta FROM t")
add("duplicate_rows", lambda s, d: profile.duplicate_rows(li(s, d).select("l_orderkey", "l_linenumber")), "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
TYPED = {"o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "real", "o_orderpriority": "text"}
add("semantic_types", lambda s, d: profile.semantic_types(table(s, d, "orders").select(*TYPED)), "SELECT col, d AS distinct_values, m AS missing, CASE WHEN d <= 1 THEN 'constant' WHEN d = 2 THEN 'binary' WHEN d = n AND t <> 'real' THEN 'identifier' WHEN t = 'real' THEN 'continuous' WHEN t = 'whole' THEN 'integer' WHEN l > 60 THEN 'text' ELSE 'category' END AS kind FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, '{t}' AS t, count(DISTINCT {c}) AS d, count(*) - count({c}) AS m, count(*) AS n, avg(length(CAST({c} AS VARCHAR))) AS l FROM orders" for c, t in TYPED.items()) + ")")

# Effects
treat = lambda s, d: frame(s, d, "treat")
T = f"f AS ({FRAMES['treat']})"
add("treatment_arms", lambda s, d: causal.arms(treat(s, d)), f"WITH {T} SELECT t, y, count(*) AS n FROM f GROUP BY t, y")
add("treatment_balance", lambda s, d: causal.balance(treat(s, d), ["o_totalprice", "c_acctbal"], ["o_orderstatus", "c_mktsegment"]), f"""WITH {T}, n AS (SELECT 'o_totalprice' AS covariate, o_totalprice AS x, t FROM f UNION ALL SELECT 'c_acctbal', c_acctbal, t FROM f), c AS (SELECT 'o_orderstatus' AS covariate, o_orderstatus AS v, t FROM f UNION ALL SELECT 'c_mktsegment', c_mktsegment, t FROM f),
g AS (SELECT covariate, abs(count(*) FILTER (t = 1) / (SELECT count(*) FROM f WHERE t = 1) - count(*) FILTER (t = 0) / (SELECT count(*) FROM f WHERE t = 0)) AS g FROM c GROUP BY covariate, v),
o AS (SELECT covariate, 'numeric' AS type, (avg(x) FILTER (t = 1) - avg(x) FILTER (t = 0)) / sqrt((var_samp(x) FILTER (t = 1) + var_samp(x) FILTER (t = 0)) / 2) AS d FROM n GROUP BY covariate UNION ALL SELECT covariate, 'categorical', max(g) FROM g GROUP BY covariate)
SELECT covariate, type, round(d, 6) AS difference, CASE WHEN abs(d) > 0.1 THEN 'Review' ELSE 'OK' END AS flag FROM o""")
PRED = "SELECT y, t, 0.02 + 0.9 * (c_acctbal + 1000) / 12000 AS e, 0.3 + o_totalprice / 1000000 AS mu0, 0.25 + o_totalprice / 1000000 AS mu1 FROM f"


def aipw(spark: SparkSession, sf_dir: str) -> DataFrame:
    treat(spark, sf_dir).createOrReplaceTempView("f")
    return causal.effects(spark.sql(PRED))


add("treatment_aipw", aipw, f"""WITH {T}, p AS ({PRED}), b AS (SELECT y, t, least(greatest(e, 0.01), 0.99) AS e, least(greatest(mu0, 1e-6), 1 - 1e-6) AS a, least(greatest(mu1, 1e-6), 1 - 1e-6) AS b FROM p),
d AS (SELECT e, b - a AS p, b - a + t * (y - b) / e - (1 - t) * (y - a) / (1 - e) AS dr FROM b), tr AS (SELECT unnest([0.0, 0.01, 0.05, 0.1])::DOUBLE AS trim)
SELECT trim, round(avg(CAST(e >= trim AND e <= 1 - trim AS INT)), 6) AS retained, round(avg(p), 6) AS plug_in, round(avg(dr) FILTER (e >= trim AND e <= 1 - trim), 6) AS aipw, 0.0::DOUBLE AS spread FROM d, tr GROUP BY trim""")
add("propensity_score", lambda s, d: causal.propensity(treat(s, d), ["o_totalprice", "c_acctbal"], ["o_orderstatus"]).select("o_orderkey", F.round("e", 4).alias("e")))
add("t_learner", lambda s, d: causal.t_learner(treat(s, d), ["o_totalprice", "c_acctbal"], ["c_mktsegment"]).select("o_orderkey", F.round("cate", 3).alias("cate")))

# Encodings
Q = f"f AS ({FRAMES['quality']})"
qual = lambda s, d: frame(s, d, "quality")
add("encode_target_mean", lambda s, d: features.target_mean(qual(s, d), "source", "quality"), f"WITH {Q}, p AS (SELECT avg(quality) AS p FROM f) SELECT source, count(*) AS n, round(1 / (1 + exp(-(count(*) - 20) / 10)) * avg(quality) + (1 - 1 / (1 + exp(-(count(*) - 20) / 10))) * any_value(p), 6) AS encoded FROM f, p GROUP BY source")
add("encode_frequency", lambda s, d: features.frequency(qual(s, d), "source"), f"WITH {Q} SELECT source, round(count(*) / (SELECT count(*) FROM f), 6) AS encoded FROM f GROUP BY source")
add("encode_ordinal", lambda s, d: features.ordinal(qual(s, d), "lang"), f"WITH {Q} SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS encoded FROM (SELECT DISTINCT lang FROM f)")
add("encode_one_hot", lambda s, d: features.one_hot(qual(s, d).select("doc_id", "lang"), ["lang"]).select("doc_id", *(F.col(f"`lang={v}`").alias(f"lang_{v}") for v in ("de", "en", "es", "fr"))), f"WITH {Q} SELECT doc_id, " + ", ".join(f"CAST(lang = '{v}' AS INT) AS lang_{v}" for v in ("de", "en", "es", "fr")) + " FROM f")
add("standardise", lambda s, d: features.standardise(table(s, d, "customer"), ["c_acctbal"]).select("c_custkey", F.round("z_c_acctbal", 6).alias("z")), "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
add("case_ids", lambda s, d: features.case_id(table(s, d, "customer").select("c_custkey"), "c_custkey"), "SELECT c_custkey, printf('CASE-%06d', row_number() OVER (ORDER BY c_custkey)) AS case_id FROM customer")
add("feature_scores", lambda s, d: features.strict_top(features.quartile_scores(frame(s, d, "score_hi"), THREE), 2), f"""WITH {long_sql('score_hi', THREE)}, e AS (SELECT col, list_sort(list_distinct(quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM wide GROUP BY col),
h AS (SELECT col, len(list_filter(e[2:len(e) - 1], lambda v: x >= v)) AS code, label, count(*) AS n FROM wide JOIN e USING (col) WHERE x IS NOT NULL GROUP BY ALL), t AS (SELECT col, n, sum(n) OVER (PARTITION BY col, code) AS s, sum(n) OVER (PARTITION BY col, label) AS k, sum(n) OVER (PARTITION BY col) AS t FROM h)
SELECT col AS feature, round(sum(-n / t * log2(k / t + 1e-15)) - sum(-n / t * log2(n / s + 1e-15)), 6) AS ig FROM t GROUP BY col ORDER BY ig DESC, feature LIMIT 2""")
add("zero_variance", lambda s, d: s.createDataFrame([(c,) for c in features.zero_variance(table(s, d, "orders").withColumn("constant", F.lit(1)))], "col string"), "SELECT 'constant' AS col")
