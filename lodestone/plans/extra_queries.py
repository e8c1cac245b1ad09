"""Queries on interactions, models, search, comparisons and explanations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import binning, explain, features, metrics, mining, models, pairs, search, statistics
from lodestone.plans.mining_queries import THREE, l1_sql, l2_sql, long_sql
from lodestone.sources.frames import FRAMES, frame, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


add("interaction_information", lambda s, d: pairs.interaction_information(frame(s, d, "xor2"), THREE), f"""WITH {long_sql('xor2', THREE)}, e AS (SELECT col, list_sort(list_distinct(quantile_cont(x, [0.25, 0.5, 0.75]))) AS e FROM wide GROUP BY col),
rid AS (SELECT row_number() OVER () AS rid, * FROM f), c AS (SELECT label AS y, {', '.join(f"len(list_filter((SELECT e FROM e WHERE col = '{c}'), lambda v: {c} >= v)) AS {c}" for c in THREE)} FROM rid),
p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS z, y FROM c" for i, a in enumerate(THREE) for b in THREE[i + 1:])}),
h AS (SELECT a, b, x, z, y, count(*) AS n FROM p GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY a, b, x, z) AS sxz, sum(n) OVER (PARTITION BY a, b, x) AS sx, sum(n) OVER (PARTITION BY a, b, z) AS sz, sum(n) OVER (PARTITION BY a, b, x, y) AS nx, sum(n) OVER (PARTITION BY a, b, z, y) AS nz, sum(n) OVER (PARTITION BY a, b, y) AS ny, sum(n) OVER (PARTITION BY a, b) AS t FROM h),
g AS (SELECT a, b, sum(-n / t * log2(ny / t + 1e-15)) AS hy, sum(-n / t * log2(n / sxz + 1e-15)) AS hab, sum(-n / t * log2(nx / sx + 1e-15)) AS ha, sum(-n / t * log2(nz / sz + 1e-15)) AS hb FROM w GROUP BY a, b)
SELECT a, b, round(hy - ha, 6) AS ig_a, round(hy - hb, 6) AS ig_b, round(hy - hab, 6) AS ig_ab, round((hy - hab) - (hy - ha) - (hy - hb), 6) AS ii FROM g""")
add("pair_scores", lambda s, d: pairs.pair_scores(frame(s, d, "xor2"), [("l_quantity", "l_discount"), ("l_quantity", "l_tax")], top=8))
add("pair_features", lambda s, d: pairs.pair_features(frame(s, d, "missing"), [("l_quantity", "product", "l_discount")]).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("`l_quantity product l_discount`"), 5).alias("z")),
    f"""WITH f AS ({FRAMES['missing']}), p AS (SELECT label, l_quantity * l_discount AS v FROM f), m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM p) SELECT label, count(*) AS n, round(avg(coalesce((v - m) / s, 0)), 5) AS z FROM p, m GROUP BY label""")


def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "score_hi").select("l_quantity", "l_discount", (2 * F.col("l_quantity") + 1).alias("copy"), (1 - F.col("l_discount")).alias("complement"), F.lit(1.0).alias("one"))
    return spark.createDataFrame(list(pairs.redundant(df, df.columns).items()), "col string, reason string")


add("redundant_columns", redundancy, "SELECT * FROM (VALUES ('copy', 'duplicate'), ('complement', 'complement'), ('one', 'constant')) AS t(col, reason)")

WORDS = "the and und"
add("search_bm25", lambda s, d: search.search(table(s, d, "documents"), WORDS), """WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w, contains(lower(text), 'the and und') AS has FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), tf AS (SELECT doc_id, has, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, (SELECT unnest(['the', 'and', 'und']) AS term)),
i AS (SELECT term, ln(1 + ((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) + max(CASE WHEN has THEN 2.5 ELSE 0 END), 6) AS score FROM tf JOIN i USING (term), s WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")

# Model comparisons: a nation is a dataset, a market segment a model, its mean balance the value.
CMP = "v AS (SELECT CAST(c_nationkey AS VARCHAR) AS dataset, c_mktsegment AS model, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY ALL)"


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("dataset"), F.col("c_mktsegment").alias("model")).agg(F.round(F.avg("c_acctbal"), 4).alias("value"))


add("matched_tasks", lambda s, d: statistics.matched(comparison(s, d)), f"WITH {CMP} SELECT * FROM v WHERE dataset IN (SELECT dataset FROM v GROUP BY dataset HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM v))")
add("average_ranks", lambda s, d: statistics.average_ranks(comparison(s, d)), f"WITH {CMP}, r AS (SELECT model, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS r FROM v) SELECT model, round(avg(r), 6) AS rank, count(*) AS datasets FROM r GROUP BY model")
add("mean_interval", lambda s, d: statistics.mean_interval(comparison(s, d)), f"WITH {CMP} SELECT model, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM v GROUP BY model")
add("pairwise_wins", lambda s, d: statistics.wins(comparison(s, d)), f"WITH {CMP} SELECT x.model AS a, y.model AS b, sum(CASE WHEN x.value > y.value THEN 1.0 WHEN x.value < y.value THEN 0.0 ELSE 0.5 END)::DOUBLE AS wins, count(*) AS n FROM v x JOIN v y ON x.dataset = y.dataset AND x.model < y.model GROUP BY 1, 2")
add("elo_ratings", lambda s, d: statistics.elo(comparison(s, d)))
add("holm_adjusted", lambda s, d: statistics.holm(comparison(s, d).groupBy("dataset").agg(F.round(F.abs(F.avg("value")) / 100000, 6).alias("p")).withColumnRenamed("dataset", "name")), f"WITH {CMP}, p AS (SELECT dataset AS name, round(abs(avg(value)) / 100000, 6) AS p FROM v GROUP BY 1), s AS (SELECT name, p, least((count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p, 1.0) AS s FROM p) SELECT name, p, round(max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM s")


# Models on patterns
def fitted(spark: SparkSession, sf_dir: str, name: str = "score_hi", bins: int = 4, length: int = 2) -> tuple[DataFrame, mining.Fit]:
    df = frame(spark, sf_dir, name)
    fit = mining.prepare(df, binning.fit_fixed(df, THREE, bins))
    mining.mine(fit, 12, length, 1e-3)
    return df, fit


#: Groups of rows by l_discount. With an indicator for each border a model without a penalty is saturated, so what it says of a group is the group's own share.
BORDERS = (0.025, 0.055, 0.085)
ABOVE = [f"above_{k}" for k in range(len(BORDERS))]
GROUP_SQL = " + ".join(f"CAST(l_discount > {b} AS INT)" for b in BORDERS)


def bordered(df: DataFrame) -> DataFrame:
    above = [(F.col("l_discount") > b).cast("int") for b in BORDERS]
    return df.select("label", sum(above[1:], above[0]).alias("discount_group"), *(c.cast("double").alias(name) for name, c in zip(ABOVE, above, strict=True)))


def pattern_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a logistic regression, fitted with next to no penalty, says of each group of rows."""
    x = bordered(frame(spark, sf_dir, "score_hi"))
    return models.with_probability(x, x, "label", "p", ABOVE, c=1e9).groupBy("discount_group").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("p"))


add("pattern_model", pattern_model, f"WITH f AS ({FRAMES['score_hi']}) SELECT {GROUP_SQL} AS discount_group, count(*) AS n, round(avg(label), 3) AS p FROM f GROUP BY 1")


def multiclass_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one regression for each class, scaled to sum to 1, says of each group of rows."""
    x = bordered(frame(spark, sf_dir, "multi3"))
    return models.one_vs_rest(x, x, "label", (0, 1, 2), ABOVE, c=1e9).groupBy("discount_group").agg(F.count("*").alias("n"), *(F.round(F.avg(f"p_{k}"), 3).alias(f"p_{k}") for k in range(3)))


add("multiclass_model", multiclass_model, f"WITH f AS ({FRAMES['multi3']}) SELECT {GROUP_SQL} AS discount_group, count(*) AS n, {', '.join(f'round(avg(CAST(label = {k} AS INT)), 3) AS p_{k}' for k in range(3))} FROM f GROUP BY 1")


def tree_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins and deviances of a round of residual trees on a feature with two values, so the split is known and leaves are Newton steps."""
    df = frame(spark, sf_dir, "score_hi").select("label", (F.col("l_quantity") > 25).cast("double").alias("high"))
    margin, loss = models.residual_trees(df, ["high"], rounds=1, depth=1)
    return df.groupBy("high").agg(F.count("*").alias("n"), F.round(F.avg(margin), 6).alias("margin")).withColumns({"deviance_before": F.round(F.lit(loss[0]), 6), "deviance_after": F.round(F.lit(loss[1]), 6)})


add("residual_trees", tree_rounds, f"""WITH f AS (SELECT label, CAST(l_quantity > 25 AS DOUBLE) AS high FROM ({FRAMES['score_hi']})), p AS (SELECT avg(label) AS p FROM f),
m AS (SELECT high, count(*) AS n, sum(label) AS s, ln(any_value(p) / (1 - any_value(p))) AS z0, ln(any_value(p) / (1 - any_value(p))) + sum(label - p) / (count(*) * any_value(p) * (1 - any_value(p)) + 1) AS z FROM f, p GROUP BY high)
SELECT high, n, round(z, 6) AS margin, round(sum(2 * (n * ln(1 + exp(z0)) - s * z0)) OVER () / sum(n) OVER (), 6) AS deviance_before, round(sum(2 * (n * ln(1 + exp(z)) - s * z)) OVER () / sum(n) OVER (), 6) AS deviance_after FROM m""")
add("no_pattern_prior", lambda s, d: models.constant_prior(frame(s, d, "null_signal")).agg(F.count("*").alias("n"), F.round(F.max("p"), 6).alias("p")), f"WITH f AS ({FRAMES['null_signal']}) SELECT count(*) AS n, round(avg(label), 6) AS p FROM f")

# Explanations
MINED = f"WITH p AS ({l2_sql('score_hi', THREE, 3, 12, 1e-3)}), u AS (SELECT DISTINCT pattern, length, support, ig, regexp_extract(unnest(string_split(pattern, ' & ')), '^[^=]+') AS source FROM p)"
add("feature_lineage", lambda s, d: explain.lineage(s, fitted(s, d, bins=3)[1]).withColumn("best_ig", F.round("best_ig", 5)), f"{MINED} SELECT source, count(*) AS patterns, round(avg(support), 6) AS mean_support, round(max(ig), 5) AS best_ig FROM u GROUP BY source")
add("pattern_families", lambda s, d: explain.families(s, fitted(s, d, bins=3)[1]), f"{MINED} SELECT length, sources, count(*) AS patterns FROM (SELECT pattern, length, string_agg(source, ', ' ORDER BY source) AS sources FROM u GROUP BY ALL) GROUP BY ALL")
add("sensitive_patterns", lambda s, d: explain.sensitive(s, fitted(s, d, bins=3)[1], ["l_tax"]), f"{MINED} SELECT pattern, bool_or(source = 'l_tax') AS sensitive FROM u GROUP BY pattern")
add("inspection_units", lambda s, d: (lambda df, fit: explain.inspection_units(mining.pattern_columns(df, fit), fit))(*fitted(s, d, bins=3)))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a keyword and a least support take out of the mined patterns."""
    fit = fitted(spark, sf_dir, bins=5, length=1)[1]
    return explain.edit(mining.table_of(spark, fit.patterns), keyword="l_tax", least_support=0.1, rows=sum(fit.totals))


add("edited_patterns", edited, f"WITH p AS ({l1_sql('score_hi', THREE, 5, 12, 1e-3)}) SELECT pattern, support, CASE WHEN contains(lower(pattern), 'l_tax') THEN 'keyword' WHEN support / (SELECT count(*) FROM lineitem) < 0.1 THEN 'low support' ELSE 'kept' END AS status FROM p")
add("pattern_set_overlap", lambda s, d: statistics.jaccard(mining.table_of(s, fitted(s, d, bins=3)[1].patterns), mining.table_of(s, fitted(s, d, "xor2", bins=3)[1].patterns)), f"""WITH a AS (SELECT DISTINCT pattern FROM ({l2_sql('score_hi', THREE, 3, 12, 1e-3)})), b AS (SELECT DISTINCT pattern FROM ({l2_sql('xor2', THREE, 3, 12, 1e-3)})), j AS (SELECT a.pattern AS x, b.pattern AS y FROM a FULL JOIN b ON a.pattern = b.pattern)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*), 6) AS jaccard FROM j""")
add("explanation_stability", lambda s, d: explain.stability(mining.table_of(s, fitted(s, d, bins=3)[1].patterns), mining.table_of(s, fitted(s, d, "multi3", bins=3)[1].patterns)), f"""WITH a AS (SELECT pattern, ig FROM ({l2_sql('score_hi', THREE, 3, 12, 1e-3)}) ORDER BY ig DESC, pattern LIMIT 20), b AS (SELECT pattern, ig FROM ({l2_sql('multi3', THREE, 3, 12, 1e-3)}) ORDER BY ig DESC, pattern LIMIT 20),
x AS (SELECT pattern, rank() OVER (ORDER BY ig) + (count(*) OVER (PARTITION BY ig) - 1) / 2 AS x FROM a), y AS (SELECT pattern, rank() OVER (ORDER BY ig) + (count(*) OVER (PARTITION BY ig) - 1) / 2 AS y FROM b), j AS (SELECT x, y FROM x FULL JOIN y USING (pattern))
SELECT round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*), 6) AS jaccard, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, round(corr(x, y), 6) AS rank_correlation FROM j""")
