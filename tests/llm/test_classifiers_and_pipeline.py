"""Quality and toxicity on held-out labels, their edge cases, and the pipeline stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewheel.llm")
from tidewheel.llm import quality_rules, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"
EDGES = [(1, "fine words here"), (2, ""), (3, None), (None, "no id"), (3, "again"), (3, "again"), (4, "x" * 5000)]


def area(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    p = labels == 1
    return (order[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_quality_on_held_out_labels(spark):
    out = queries.op1_quality_rules(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert area(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert ((held.score >= 0.3) == held.predicted).all() and held.score.between(0, 1).all()


def test_toxicity_on_held_out_labels(spark):
    out = queries.op9_toxicity(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert area(held.score.to_numpy(), held.toxic.to_numpy()) > 0.85
    assert (held[held.predicted == 1].toxic == 1).mean() > 0.8


def test_edges_and_missing_labels(spark):
    df = spark.createDataFrame(EDGES, "doc_id int, text string").withColumn("label", F.lit("clash"))
    none = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id int, quality int, toxic int")
    model = toxicity.fit(df, none, F.lit(False))
    assert {round(x.toxicity, 6) for x in toxicity.score(df, model).collect()} == {round(2 / 3, 6)}
    rules = quality_rules.fit(df, none, F.lit(False))
    scored = quality_rules.score(df, rules).collect()
    assert len(scored) == len(EDGES) and {round(x.quality, 6) for x in scored} == {round(2 / 3, 6)}
    assert toxicity.score(df.limit(0), model).count() == quality_rules.score(df.limit(0), rules).count() == 0


def test_rules_are_compiled_as_they_are_learnt(spark):
    r = np.random.default_rng(1)
    x = r.random((400, len(quality_rules.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.7)).astype(float)
    model = quality_rules.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], list(quality_rules.STATISTICS)).select(F.struct(*quality_rules.STATISTICS).alias("stat"))
    got = [v.p for v in df.select(quality_rules.compiled(model).alias("p")).collect()]
    names = list(quality_rules.STATISTICS)
    want = [1 / (1 + np.exp(-(model.intercept + sum(w * all((v[names.index(n)] > c) == o for n, o, c in rule) for rule, w in model.rules)))) for v in x]
    assert np.allclose(got, want) and ((np.array(got) > 0.5) == y).mean() > 0.97


def test_logistic_reaches_the_optimum():
    r = np.random.default_rng(5)
    x = (r.random((200, 6)) < 0.4).astype(float)
    y = (r.random(200) < 1 / (1 + np.exp(-(x @ [2, -2, 1, 0, 0, 1] - 0.5)))).astype(float)
    row, col = np.nonzero(x)
    b, w = toxicity.logistic(row, col, np.ones(6), y, 6)
    e = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert abs(e.sum()) < 0.1 and np.abs(x.T @ e + toxicity.PENALTY * w).max() < 0.1


def test_pipeline_stage_by_stage(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = pipeline.written(stage(spark, docs, sf))
        before, after = {x.doc_id for x in docs.select("doc_id").collect()}, [x.doc_id for x in out.select("doc_id").collect()]
        assert set(after) <= before and after
        if i + 1 < len(pipeline.STAGES):
            assert out.columns == docs.columns
        if name == "near duplicates":
            found = pipeline.near_dup.near_duplicates(docs, percent=80).collect()
            assert sorted(after) == sorted(x.doc_id for x in found if x.kept)
        if name in ("secrets", "byte-level BPE"):
            assert sorted(after) == sorted(x.doc_id for x in docs.select("doc_id").collect())
        docs = out
    assert {x.ok for x in docs.selectExpr("sha2(ids, 256) = ids_sha256 as ok").distinct().collect()} == {True}
