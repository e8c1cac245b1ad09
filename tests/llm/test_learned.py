"""Near duplicates, vectors, classifiers, secrets and the pipeline, against plain versions and labels."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import embedding_dedup, language_id, minhash_dedup, quality, secrets, toxicity
from lodestone.llm.common import connected, table
from lodestone.llm.linear import crc
from tests.llm.conftest import text

SF = "/root/testdata/sf0.01"


def bag(t):
    w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in set(a) & set(b))


def test_probability_jaccard_is_its_definition():
    rng = random.Random(2)
    for _ in range(30):
        a, b = text(rng, 12) + " w1 w1 w1 w1 w1 w1 w1", text(rng, 4)
        b = a[: len(a) // 2] + " " + b
        got = minhash_dedup.probability_jaccard(minhash_dedup.bag(a), minhash_dedup.bag(b))
        assert math.isclose(got, similarity(bag(a), bag(b)), abs_tol=1e-12)


def test_registers_agree_as_often_as_the_similarity_says():
    rng = random.Random(4)
    base = text(rng, 80).split()
    for cut in (5, 20, 45):
        other = " ".join(base[:cut] + text(rng, 5).split() + base[cut:] + ["w1"] * 12)
        bags = [minhash_dedup.bag(" ".join(base)), minhash_dedup.bag(other)]
        s = minhash_dedup.signatures(bags, 4000)
        j = minhash_dedup.probability_jaccard(*bags)
        assert abs((s[0] == s[1]).mean() - j) < 4 * math.sqrt(j * (1 - j) / 4000) + 1e-9
    assert (minhash_dedup.signatures([minhash_dedup.bag("one")], 64) == minhash_dedup.bag("one")[0][0]).all()
    assert (minhash_dedup.signatures([minhash_dedup.bag("")], 8) == 0).all()


def groups_of(n, linked):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


def test_groups_of_near_copies_as_by_comparing_all_pairs(spark):
    rng = random.Random(11)
    base = [text(rng, rng.randrange(3, 90)) for _ in range(12)]
    docs = []
    for k in range(70):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(50))
        docs.append(" ".join(w))
    docs += ["", "  ", "the the the the the the the the", "the the the the the the the the the the the", "one two", "One, two!"]
    bags = [bag(t) for t in docs]
    expected = groups_of(len(docs), lambda a, b: bool(bags[a]) and bool(bags[b]) and similarity(bags[a], bags[b]) >= 0.8)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert [got[k].component_id for k in range(len(docs))] == expected
    assert all(got[k].kept == (expected[k] == k) for k in got)


@pytest.mark.parametrize("block", [256, 16])
def test_a_large_bucket_of_different_documents_is_compared_in_full(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block, raising=False)
    monkeypatch.setattr(minhash_dedup, "TOGETHER", 3000, raising=False)
    rng = random.Random(13)
    docs = []
    for _ in range(200):
        w = ("q " * 200 + text(rng, 120)).split()
        docs += [" ".join(w), " ".join([*w[:250], "zz", *w[251:]])]
    # One band of one register, which most documents spend on what all have in common: no other bucket tells them apart.
    register = minhash_dedup.signatures([minhash_dedup.bag(t) for t in docs], 1)[:, 0]
    assert Counter(register).most_common(1)[0][1] > 200
    expected = [k - k % 2 if register[k] == register[k - k % 2] else k for k in range(len(docs))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bands=1, rows=1).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(expected))


def test_texts_are_read_again_without_a_shuffle_of_all(spark):
    """A few ids are broadcast whatever Spark's own limit is; each text comes once."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = spark.createDataFrame([(k % 500, f"text {k % 500}") for k in range(1000)], "doc_id long, text string")
        out = minhash_dedup.read_again(data, spark.createDataFrame([(3,), (77,), (9999,)], "doc_id long"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(tuple(r) for r in out.collect()) == [(3, "text 3"), (77, "text 77")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_near_copies_of_odd_input(odd, empty):
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert [r.kept for r in rows if r.doc_id in (1, 2, 3)] == [True] * 3
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_connected_groups(spark):
    rng = random.Random(8)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(600, 700)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = {frozenset(p) for p in pairs}
    expected = groups_of(700, lambda a, b: frozenset((a, b)) in links)
    assert got == {n: expected[n] for p in pairs for n in p if p[0] != p[1]}


def test_vectors_as_by_comparing_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([centres[rng.integers(0, 40, 500)] + rng.normal(size=(500, 24)) * rng.choice([0.05, 0.2, 0.6], (500, 1)), rng.normal(size=(300, 24))])
    x[5] = x[4]
    x[6] = 2 * x[4]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, [1.0, 2.0]), (905, [])]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.97 * near.sum()
    assert [got[k].n_links for k in range(900, 906)] == [0] * 6
    if (found == near.sum(axis=1)).all():
        assert [got[k].component_id for k in range(len(x))] == groups_of(len(x), lambda a, b: near[a, b])
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("sample", [8192, 4])
def test_vectors_of_each_length_link(spark, monkeypatch, sample):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", sample)
    rng = np.random.default_rng(5)
    x = [*rng.normal(size=(60, 12)), *rng.normal(size=(2, 5)), rng.normal(size=30)]
    near = [v + 0.01 * rng.normal(size=len(v)) for v in x[:-1]]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate([*x, *near])]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k in range(62):
        assert got[63 + k].component_id == got[k].component_id, k
    assert got[62].n_links == 0 and len({got[k].component_id for k in range(60)}) > 50


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_links_found_over_many_lists(spark, monkeypatch, kind):
    """Near pairs with cosines from just above the threshold on, against all pairs, with over 100 lists."""
    monkeypatch.setattr(embedding_dedup, "LIST", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32)) if kind == "random" else rng.normal(size=(60, 32))[rng.integers(0, 60, 1500)] + 0.8 * rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.95, (1500, 1))
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * z])
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[k] for k in range(len(x))])
    print(kind, found.sum(), near.sum())
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum() > 2000


def test_vectors_with_nulls_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (1, [0.0, 1.0], "c"), (2, [0.0, 2.0], "d"), (3, [3.0, 0.1], "e"), (None, None, "f")]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string")).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_quality_of_rows_that_were_held_out(spark):
    got = quality.op4_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.9


def test_toxicity_of_rows_that_were_held_out(spark):
    got = toxicity.op10_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.85


def test_language_of_rows_that_were_held_out(spark):
    got = language_id.op7_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_classifiers_on_odd_input(spark, odd, empty):
    known = table(spark, SF, "documents").where(F.pmod(crc(), F.lit(3)) != 1)
    model = language_id.fit(known)
    rows = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert {rows[k].lang_pred for k in (1, 2, 3, 8)} == {"und"} and rows[1].score == 0.0
    assert language_id.identify(empty, model).count() == 0 and language_id.fit(empty.withColumn("lang", F.lit("en"))) is None
    labels = table(spark, SF, "labels")
    for module, column in ((quality, "score"), (toxicity, "p_toxic")):
        fitted = module.fit(known, labels)
        scores = [r[column] for r in module.scored(odd, fitted).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
        assert module.scored(empty, fitted).count() == 0
        assert module.scored(odd, module.fit(empty, labels)).count() == odd.count()


def test_secrets(spark, odd, empty):
    texts = [
        (1, 'see config token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" and go on', True),
        (2, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixes it", False),
        (3, 'api_key: "your_api_key_here_12"', False),
        (4, "password = hunter2xK9!q", None),
        (5, "nothing to see", None),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string, flag boolean")
    rows = secrets.scan(df).collect()
    for doc, t, flag in texts:
        own = [r for r in rows if r.doc_id == doc]
        assert all(t[r.start : r.start + len(r.v)] == r.v for r in own)
        if flag is not None:
            assert [r.secret for r in own] == [flag]
    assert not [r for r in rows if r.doc_id == 5]
    secrets.scan(odd).count()
    assert secrets.scan(empty).count() == 0


def test_forest_tells_held_out_findings(spark):
    findings = secrets.labelled_findings(spark, 3000)
    forest = secrets.Forest(findings.where(F.crc32(F.col("v").cast("binary")) % 4 != 0))
    rest = secrets.featured(findings.where(F.crc32(F.col("v").cast("binary")) % 4 == 0)).select(((forest.score() >= 0.5).cast("int") == F.col("label")).cast("int").alias("right"))
    assert rest.agg(F.avg("right")).first()[0] > 0.95


def test_pipeline_keeps_columns_and_decides(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            path = f"file://{tmp_path}/{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.count() <= before
            before = docs.count()
        else:
            total = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
            assert total.count() == before and total.where("n <> t").count() == 0


def test_pipeline_of_odd_input(spark, sf, odd, empty, tmp_path):
    docs = table(spark, sf, "documents").limit(30).unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            docs.write.parquet(f"file://{tmp_path}/{k}")
            docs = spark.read.parquet(f"file://{tmp_path}/{k}")
    assert docs.count() > 0


@pytest.mark.parametrize("k", range(5))
def test_stage_of_an_empty_table(spark, sf, k):
    nothing = table(spark, sf, "documents").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, nothing, sf).count() == 0
