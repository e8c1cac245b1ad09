"""Operators beyond the queries: sources, models, streams, odd input."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import information
from lodestone.operators import binning, causal, drift, features, metrics, mining, pairs, profile, sampling
from lodestone.sources import tables
from lodestone.sources.frames import frame, split_by_order, table
from lodestone.streaming import scoring

THREE = ["l_quantity", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def fit(spark, sf):
    df = frame(spark, sf, "score_hi")
    f = mining.prepare(df, binning.fit_fixed(df, THREE, 3))
    mining.mine(f, 6, 2, 1e-3)
    return f


def test_three_logarithms():
    assert math.isclose(information.entropy([1, 1]), math.log(2))
    assert math.isclose(information.entropy_bits([1, 1]), 1.0, abs_tol=1e-9)
    assert information.gain([2, 0], [2, 0]) is None
    assert information.pearson([(1, 0, 5), (1, 1, 5)]) == 0.0
    assert math.isclose(information.normalised_information([5, 0], [5, 5]), 1.0)


def test_fit_survives_a_round_trip_and_tells_tampering(spark, fit, tmp_path):
    path = f"file://{tmp_path}/fit"
    tables.save_fit(spark, fit, path, b"key")
    back = tables.load_fit(spark, path, b"key")
    assert [p.name for p in back.patterns] == [p.name for p in fit.patterns] and back.bins == fit.bins
    with pytest.raises(ValueError, match="signature"):
        tables.load_fit(spark, path, b"other")


def test_tables_by_ending(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "a.tsv").write_text("x\ty\n1\ta\n")
    assert tables.read_table(spark, f"file://{tmp_path}/a.csv").count() == 2
    assert tables.read_table(spark, f"file://{tmp_path}/a.tsv").columns == ["x", "y"]
    with pytest.raises(ValueError, match="repeated"):
        tables.check_header(["a", "A"])
    df = spark.createDataFrame([("no", 1), ("yes", 2), (None, 3)], "t string, v int")
    assert [r.label for r in tables.model_frame(df, "t").orderBy("v").collect()] == [0, 1]


def test_stream_scores_like_a_batch(spark, sf, fit, tmp_path):
    stream = spark.readStream.schema(table(spark, sf, "lineitem").schema).parquet(f"{sf}/lineitem.parquet*").select(*THREE)
    weights = [0.5] * len(fit.patterns)
    scoring.to_table(scoring.scored(stream, fit, weights), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").agg(F.count("*"), F.round(F.avg("p"), 9)).first()
    assert got == scoring.scored(table(spark, sf, "lineitem").select(*THREE), fit, weights).agg(F.count("*"), F.round(F.avg("p"), 9)).first()


def test_windows_of_a_stream(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    q = scoring.windowed(stream, "ts", "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"file://{tmp_path}/w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_split_is_the_first_rows_in_order(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7, F.lit(10)).alias("a"), F.col("id").alias("b"))
    got = split_by_order(df, ["a", "b"]).where("part = 'reference'").collect()
    assert sorted((r.a, r.b) for r in got) == sorted((r.a, r.b) for r in df.collect())[:700]


def test_odd_values(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 0), (float("inf"), 1), (None, 0)], "x double, label int")
    assert profile.numeric_profile(df, ["x"]).first()["missing"] == 3
    assert metrics.auc(df.select(F.lit(0.5).alias("p"), F.lit(1).alias("y"))).first()["auc"] is None
    assert features.zero_variance(df.withColumn("c", F.lit(2))) == ["x", "c"]
    assert pairs.redundant(df.select(F.col("label").alias("a"), (1 - F.col("label")).alias("b")), ["a", "b"]) == {"b": "complement"}
    assert drift.ks(df.withColumn("part", F.lit("reference")), "x").first()["ks"] is None


def test_effects_over_repeats(spark):
    rows = [(k, k % 2, (k * 7) % 3 // 2, 0.3 + 0.1 * (k % 5), 0.4, 0.5) for k in range(100)]
    df = spark.createDataFrame(rows, "k int, t int, y int, e double, mu0 double, mu1 double")
    twice = df.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1))))
    assert causal.effects(df).collect() == causal.effects(twice).select(*causal.effects(df).columns).collect()


def test_samples_and_folds_dont_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("label", F.col("id") % 2)
    pick = lambda x: {r.id for r in sampling.stratified_sample(x, "id", "label", 0.1).collect()}
    assert pick(df) == pick(df.repartition(7)) and len(pick(df)) == 500
    assert sampling.folds(df, "id").where("fold = validation").count() == 0


def test_grid_is_checked_and_shares_work(spark, sf):
    from lodestone.operators import tuning

    with pytest.raises(ValueError, match="can't vary"):
        tuning.expand({"depth": [1]})
    assert len(tuning.expand(tuning.GRIDS["standard"])) == 8
    df = frame(spark, sf, "score_hi").limit(2000)
    got = tuning.tune(df, THREE, {"bins": [4], "length": [1, 2], "top": [8]}, folds=2)
    assert got.score == max(r["auc"] for r in got.results) > 0.9 and got.fit.patterns


def test_resampled_classes_are_of_about_one_size(spark):
    from lodestone.operators import tuning

    df = spark.range(4000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    for how, size in (("under", 400), ("over", 3600)):
        counts = {r[0]: r[1] for r in tuning.resample(df, "id", how=how).groupBy("label").count().collect()}
        assert all(abs(n - size) < 0.15 * size for n in counts.values())
    assert {round(r.weight, 3) for r in tuning.class_weights(df).select("weight").distinct().collect()} == {0.556, 5.0}


def test_percentiles_are_exact_and_gathered_by_no_task(spark, sf, monkeypatch):
    from lodestone.operators import quantiles

    at = [0.0, 0.1, 0.25, 0.5, 1 / 3, 0.9, 1.0]
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    df = spark.range(20000).select(
        u.alias("even"), F.floor(u * 7).cast("double").alias("few"), F.when(F.col("id") == 5, 1e300).otherwise(u).alias("far"), F.lit(None).cast("double").alias("none"), F.lit(3.5).alias("one"),
        (F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0) * F.pow(F.lit(10.0), F.floor(600 * u) - 300)).alias("decades"), F.when(F.col("id") % 3 == 0, u * 1.7e308).otherwise(-u * 1.7e308).alias("wide"),
    )
    expected = df.agg(*(F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in df.columns)).first()
    passes = []
    monkeypatch.setattr(quantiles, "_range", lambda *a, f=quantiles._range: (passes.append(a[3]), f(*a))[1])
    assert quantiles.percentiles(df, {c: F.col(c) for c in df.columns}, at) == {c: expected[c] for c in df.columns}
    assert max(passes) < 12

    def gathers(*_):
        raise AssertionError("one task reads all distinct values of a column")

    monkeypatch.setattr(F, "percentile", gathers)
    assert profile.numeric_profile(table(spark, sf, "lineitem"), THREE).count() == 3


def test_regressions_share_few_passes(spark, sf, monkeypatch):
    from lodestone.operators import models

    passes = []
    monkeypatch.setattr(models, "_derivatives", lambda *a, f=models._derivatives: (passes.append(len(a[1])), f(*a))[1])
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    df = spark.range(20000).select(u(1).alias("a"), (100 * u(2)).alias("b"), u(3).alias("e")).withColumn("y", F.floor(F.col("a") + F.col("b") / 100 + F.col("e")).cast("int")).withColumn("t", (F.col("y") > 0).cast("int")).persist()
    fitted = models.fit_all(df, [F.col("y") == k for k in range(3)], ["a", "b"], c=0.05)
    assert len(passes) < 15 and max(passes) == 3
    # At the optimum the loss's gradient is within the penalty, and on its border for weights other than 0.
    for k, v in enumerate(fitted):
        r = models.logistic(models.margin(["a", "b"], v)) - (F.col("y") == k).cast("double")
        g = df.agg(F.sum(r), F.sum(r * F.col("a")), F.sum(r * F.col("b"))).first()
        assert abs(g[0]) < 1e-3
        assert all(abs(s + math.copysign(20, w)) < 1e-2 if w else abs(s) <= 20.01 for s, w in zip(g[1:], v[1], strict=True))
    plain = models.fit_logistic(df, "t", ["a", "b"], l1=0.0)
    wide = models.fit_logistic(df, "t", ["a", "b", *(F.lit(0.0) for _ in range(40))], l1=0.0)  # by Spark ML
    assert all(math.isclose(p, q, rel_tol=1e-2) for p, q in zip([plain[0], *plain[1]], [wide[0], *wide[1][:2]], strict=True))
    assert models.fit_logistic(df.withColumn("t", F.lit(1)), "t", ["a"])[1] == [0.0]
