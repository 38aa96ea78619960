"""Boosting from sums over blocks: against a plain growth of the same trees, however the rows are dealt out."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tierscope.config import CONFIG
from tierscope.plans import trees as T


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(8)
    rows = [(i, rng.random(), float(rng.randint(0, 3)), float(rng.randint(0, 4)), 7.0, float(min(2, rng.randint(0, 2)))) for i in range(300)]
    rows = [(k, x, y, b, c, label if x < 0.6 else float(y > 1) + float(b == 2)) for k, x, y, b, c, label in rows]
    df = spark.createDataFrame(rows, "key long, x double, y double, b double, same double, label_idx double").repartition(3)
    df = OneHotEncoder(inputCols=["b"], outputCols=["hot"], dropLast=True).fit(df).transform(df)
    return VectorAssembler(inputCols=["x", "y", "hot", "same"], outputCol="features").transform(df).select("key", "features", "label_idx").checkpoint()


def plain(x, label, b, limits, rounds):
    """All rows, all columns: every node tries every limit of every column; margins of the rows."""
    m = np.zeros((len(x), 3))
    for _ in range(rounds):
        e = np.exp(m)
        p = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(m)
        for k in range(3):
            g, h = (label == k) - p[:, k], 2 * p[:, k] * (1 - p[:, k])

            def grow(rows, depth, g=g, h=h, k=k):
                def worth(r):
                    return g[r].sum() ** 2 / (h[r].sum() + b.penalty)

                best = (1e-9, None)
                for c, limit in enumerate(limits if depth else []):
                    for t in limit:
                        left, right = rows[x[rows, c] <= t], rows[x[rows, c] > t]
                        if min(h[left].sum(), h[right].sum()) >= b.least:
                            gain = worth(left) + worth(right) - worth(rows)
                            best = max(best, (gain, (left, right)), key=lambda v: v[0])
                if best[1] is None:
                    step[rows, k] = b.step * g[rows].sum() / (h[rows].sum() + b.penalty)
                else:
                    for part in best[1]:
                        grow(part, depth - 1)

            grow(np.arange(len(x)), b.depth)
        m += step
    return m


def scored(spark, trees, vectors):
    out = vectors.select("key", T.summed(trees, spark)(vector_to_array("features")).alias("m")).orderBy("key")
    return np.array([r["m"] for r in out.collect()])


def test_trees_are_those_of_a_plain_growth_in_one_block_and_in_many(spark, vectors, tmp_dir, monkeypatch):
    b = T.Boosting(rounds=3, step=0.4, depth=4, rows=1.0, columns=1.0, every=2)
    rows = vectors.select("key", vector_to_array("features").alias("x"), "label_idx").orderBy("key").collect()
    x, label = np.array([r["x"] for r in rows]), np.array([r["label_idx"] for r in rows])
    columns = T.binned_columns(vectors.select(vector_to_array("features").alias("x")), x.shape[1])
    assert columns.hot.tolist() == [2, 3, 4, 5] and [len(v) for v in columns.limits] == [31, 3, 1, 1, 1, 1, 0]
    want = plain(x, label, b, columns.limits, 3)
    one = T.fit_boosting(vectors, b, tmp_dir + "/one", 3)
    monkeypatch.setattr(T, "TOGETHER", 10)
    many = T.fit_boosting(vectors, b, tmp_dir + "/many", 3)
    assert np.allclose(scored(spark, one, vectors), want) and np.allclose(scored(spark, many, vectors), want)
    # A run that is cut off goes on with the margins of its trees.
    more = T.fit_boosting(vectors, T.Boosting(rounds=5, step=0.4, depth=4, rows=1.0, columns=1.0, every=2), tmp_dir + "/many", 3)
    assert len(more.roots) == 15 and np.allclose(scored(spark, more, vectors), plain(x, label, b, columns.limits, 5))


def test_rows_and_columns_are_drawn_by_key_and_class(spark, vectors, tmp_dir, monkeypatch):
    b = T.Boosting(rounds=2, step=0.4, depth=3, rows=0.7, columns=0.5)
    one = T.fit_boosting(vectors, b, tmp_dir + "/one", 3)
    monkeypatch.setattr(T, "TOGETHER", 10)
    many = T.fit_boosting(vectors.repartition(7), b, tmp_dir + "/many", 3)
    assert np.allclose(scored(spark, one, vectors), scored(spark, many, vectors))
    block = T._blocks(vectors.select("key", F.xxhash64("key").alias("draw"), vector_to_array("features").alias("x"), "label_idx"),
                      T.Columns([np.zeros(0)] * 7, np.arange(7), np.zeros(0, int)), 3, 1, None).first()[0]
    drawn = [block.drawn(b, r) for r in range(20)]
    assert 0.65 < np.mean(drawn) < 0.75 and (drawn[0] != drawn[1]).any()
    assert all(len(T.planted(T.Columns([np.zeros(0)] * 7, np.arange(7), np.zeros(0, int)), b, 0, k).drawn) == 4 for k in range(3))


def test_queries_boost_for_all_rounds():
    from tierscope.plans import model as M
    from tierscope.plans import registry as R
    boosting = M.candidates(R.QUERY_CFG)["gradient_boosting"].estimator
    assert (boosting.rounds, boosting.depth) == (CONFIG.model.boosting_rounds, CONFIG.model.boosting_depth) == (600, 7)
