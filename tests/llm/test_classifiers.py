"""Held-out accuracy of the toxicity and quality classifiers, and awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"
AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "word " * 40_000), (5, "é # ü!!\n\n|x|"), (5, "é # ü!!\n\n|x|")]


def rates(rows, labels, column):
    found = {(r.y, r.predicted): r.n for r in rows.where("held_out").join(labels, "doc_id").where(F.col(column).isNotNull()).groupBy(
        F.col(column).alias("y"), "predicted").agg(F.count("*").alias("n")).collect()}
    get = lambda y, p: found.get((y, p), 0)
    return get(1, 1) / (get(1, 1) + get(1, 0)), get(0, 1) / (get(0, 1) + get(0, 0))


def test_toxicity_held_out(spark):
    rows = toxicity.op2_toxicity(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows.count() == docs.count()
    caught, wrong = rates(rows, spark.read.parquet(f"{FOLDER}/labels.parquet"), "toxic")
    assert caught > 0.85 and wrong < 0.02


def test_quality_held_out(spark):
    caught, wrong = rates(quality.op3_quality(spark, FOLDER), spark.read.parquet(f"{FOLDER}/labels.parquet"), "quality")
    assert caught > 0.98 and wrong < 0.05


@pytest.mark.parametrize("labelled", [True, False])
def test_awkward_texts(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x") for i, t in AWKWARD], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 0), (99, 1, 1)] if labelled else [],
                                   "doc_id long, quality int, toxic int")
    for rows in (toxicity.score(docs, *toxicity.train(docs, labels)), quality.train(docs, labels)(docs)):
        got = rows.collect()
        assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 5]
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.keep_clean(docs, docs, labels).columns == docs.columns
    assert toxicity.score(docs.limit(0), *toxicity.train(docs, labels)).count() == 0


def test_risk_never_trusts_a_negative_estimate():
    rng = np.random.default_rng(0)
    rows = lambda n, lo: toxicity.Sparse(rng.integers(lo, lo + 5, 3 * n), np.repeat(np.arange(n), 3), n, 10)
    weights, base = toxicity.fit(rows(20, 0), rows(60, 5), 0.3, 1)
    assert weights[:5].min() > weights[5:].max() and np.isfinite(base)


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit(x, y)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return total

    assert np.allclose(trees.margin(x), [walk(r) for r in x])
    assert ((trees.margin(x) > 0) == (y > 0.5)).mean() > 0.97


def test_statistics_of_two_texts_equal_those_of_each(spark):
    import pyarrow as pa

    texts = ["One two two.\nOne two two.\n", "", "a|b ### !!", None]
    together = quality.statistics(pa.array(texts))
    apart = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, apart) and together.shape == (4, len(quality.NAMES))


def test_repeated_ids_give_one_model(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    texts = [(i % 80, " ".join(rng.choice(words, 30)) + (" vile" if i % 3 == 0 else "")) for i in range(200)]
    labels = [(i % 80, int(i % 2 == 0), int(i % 3 == 0)) for i in range(160)]
    found = []
    for turn in (1, -1):
        docs = spark.createDataFrame(texts[::turn], "doc_id long, text string").repartition(3)
        marks = spark.createDataFrame(labels[::turn], "doc_id long, quality int, toxic int").repartition(2)
        weights, base = toxicity.train(docs, marks)
        scores = sorted((r.doc_id, round(r.score, 9)) for r in quality.train(docs, marks)(docs).collect())
        found.append((weights.tolist(), base, scores))
    assert found[0] == found[1]
