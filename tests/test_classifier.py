"""The classifier as a whole."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.operators.classifier import MODES, PatternClassifier
from lodestone.plans.mining_queries import THREE
from lodestone.sources import tables
from lodestone.sources.frames import frame


def test_modes_budgets_and_round_trip(spark, sf, tmp_path):
    df = frame(spark, sf, "score_hi").limit(3000).persist()
    blocks = {m: {f.block for f in PatternClassifier(THREE, length=2, top=20, mode=m).fit(df).features} for m in MODES[:2]}
    assert blocks["patterns_only"] == {"pattern"} and blocks["original_plus_patterns"] == {"orig", "pattern"}
    model = PatternClassifier(THREE, length=2, top=20, mode="original_plus_interactions", pair_top=2, budget=6).fit(df)
    assert len(model.features) == 6 and all(len(f.sources) > 1 for f in model.features if f.block == "pattern")
    scored = model.predict_proba(df)
    assert metrics.auc(scored, "label", "p_1").first()[0] > 0.95
    assert scored.where("abs(p_0 + p_1 - 1) > 1e-12 or prediction <> cast(p_1 >= 0.5 as int)").count() == 0
    tables.save_model(spark, model, f"file://{tmp_path}/m", b"key")
    again = tables.load_model(spark, f"file://{tmp_path}/m", b"key").predict_proba(df)
    assert again.agg(F.sum("p_1")).first() == scored.agg(F.sum("p_1")).first()
    with pytest.raises(ValueError, match="signature"):
        tables.load_model(spark, f"file://{tmp_path}/m", b"other")
    # Contributions of all sources are the margin less its mean.
    c = model.contributions(scored).select((F.ln("p_1") - F.ln("p_0")).alias("z"), sum((F.col(f"contribution_{x}") for x in THREE), F.lit(0.0)).alias("s"))
    mean = c.agg(F.avg("z")).first()[0]
    assert c.agg(F.max(F.abs(F.col("z") - F.col("s") - mean))).first()[0] < 1e-6
    heaviest = model.importances(spark).first().feature
    assert heaviest not in [f.full_name for f in model.without([heaviest]).features]


def test_several_classes_missing_values_and_one_class(spark, sf):
    df = frame(spark, sf, "multi3").limit(3000).withColumn("l_tax", F.when(F.col("l_tax") > 0.03, F.col("l_tax"))).persist()
    model = PatternClassifier(THREE, length=1, top=15, mode="original_plus_patterns", original_top=2).fit(df)
    assert sum(f.block == "orig" for f in model.features) == 2 and model.classes == [0, 1, 2]
    scored = model.predict_proba(df.withColumn("l_quantity", F.lit(None).cast("double")))
    assert scored.where("p_0 is null or abs(p_0 + p_1 + p_2 - 1) > 1e-9").count() == 0
    assert metrics.multiclass(model.predict_proba(df), (0, 1, 2)).first()["accuracy"] > 0.7
    one = PatternClassifier(THREE).fit(df.where("label = 1"))
    assert {r[0] for r in one.predict_proba(df).select("p_1").distinct().collect()} == {1.0}
    with pytest.raises(ValueError, match="mode"):
        PatternClassifier(THREE, mode="all")
    with pytest.raises(ValueError, match="missing"):
        model.predict_proba(df.drop("l_tax"))
