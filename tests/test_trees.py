"""Forests in parts, staged boosting, and their evaluation against MLlib's own trees."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tierscope.plans import trees as T


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        x, y, b = rng.random(), rng.random(), float(rng.randint(0, 1))
        label = 2.0 if (x - 0.5) ** 2 + (y - 0.5) ** 2 < 0.06 else b
        rows.append((i, x, y, b, rng.random(), label if rng.random() > 0.05 else float(rng.randint(0, 2)), 1.0 + i % 2))
    df = spark.createDataFrame(rows, "key long, x double, y double, b double, noise double, label_idx double, weight double")
    # A one-hot column is nominal to MLlib, so its splits are by category.
    from pyspark.ml.feature import OneHotEncoder
    df = OneHotEncoder(inputCols=["b"], outputCols=["hot"], dropLast=False).fit(df).transform(df)
    return VectorAssembler(inputCols=["x", "y", "hot", "noise"], outputCol="features").transform(df).select("key", "features", "label_idx", "weight").checkpoint()


def forest(trees=6, depth=5, seed=3):
    return RandomForestClassifier(labelCol="label_idx", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def test_arrays_say_what_mllib_says(spark, vectors, tmp_dir):
    model = forest().fit(vectors)
    model.write().save(tmp_dir + "/model")
    trees = T.read_trees(spark, tmp_dir + "/model", T.shares)
    assert len(trees.roots) == 6
    out = model.transform(vectors).withColumn("mine", T.summed(trees, spark)(vector_to_array("features"))).select(
        vector_to_array("rawPrediction").alias("raw"), "mine").collect()
    assert np.allclose([r["raw"] for r in out], [r["mine"] for r in out])


def test_parts_add_up_to_the_forest(spark, vectors, tmp_dir):
    whole = forest(7)
    parts = T.fit_forest(vectors, whole, tmp_dir, 3)
    models = [forest(n, seed=3 + i).fit(vectors) for i, n in enumerate((3, 3, 1))]
    trees = T.forest_trees(spark, parts)
    assert len(trees.roots) == 7
    out = vectors.withColumn("mine", T.summed(trees, spark)(vector_to_array("features")))
    votes = [np.array([r["raw"] for r in m.transform(vectors).select("key", vector_to_array("rawPrediction").alias("raw")).orderBy("key").collect()]) for m in models]
    mine = np.array([r["mine"] for r in out.orderBy("key").collect()])
    assert np.allclose(mine, sum(votes) / 7) and np.allclose(mine.sum(axis=1), 1)
    importances = sum(n * m.featureImportances.toArray() for n, m in zip((3, 3, 1), models))
    assert np.allclose(T.forest_importances(spark, parts), importances / importances.sum())
    # A second run finds all parts; a run with more trees trains only what is new.
    assert T.fit_forest(vectors, whole, tmp_dir, 3) == parts
    assert T.fit_forest(vectors, forest(9), tmp_dir, 3)[:2] == parts[:2]


def margins(spark, trees, vectors):
    out = vectors.withColumn("m", T.summed(trees, spark)(vector_to_array("features"))).orderBy("key")
    return np.array([r["m"] for r in out.select("m").collect()])


def test_boosting_fits_and_goes_on_where_it_was_cut_off(spark, vectors, tmp_dir, monkeypatch):
    b = T.Boosting(rounds=6, step=0.3, depth=3, every=2)
    whole = T.fit_boosting(vectors, b, tmp_dir + "/whole", 3)
    grown, calls = T._grown, []

    def cut_off(data, b, r, k, *more):
        calls.append(r)
        if r == 5 and len(calls) < 100:
            raise RuntimeError("executor lost")
        return grown(data, b, r, k, *more)

    monkeypatch.setattr(T, "_grown", cut_off)
    with pytest.raises(RuntimeError):
        T.fit_boosting(vectors, b, tmp_dir + "/resumed", 3)
    assert T.load_boosting(spark, tmp_dir + "/resumed")[0] == 4
    calls += [0] * 100
    resumed = T.fit_boosting(vectors, b, tmp_dir + "/resumed", 3)
    assert calls[-3:] == [5] * 3 and 3 not in calls[-6:]
    assert len(whole.roots) == len(resumed.roots) == 18
    m = margins(spark, whole, vectors)
    assert np.allclose(m, margins(spark, resumed, vectors))
    # The margins that were carried along are those of the finished trees.
    last = T.load_boosting(spark, tmp_dir + "/whole")[2]
    carried = np.array([list(r)[1:] for r in spark.read.parquet(f"{last}/margins").select("key", "m0", "m1", "m2").orderBy("key").collect()])
    assert np.allclose(m, carried)
    label = np.array([r[0] for r in vectors.orderBy("key").select("label_idx").collect()])
    assert (m.argmax(axis=1) == label).mean() > 0.9
    p = vectors.withColumn("m", T.summed(whole, spark)(vector_to_array("features"))).select(
        F.array(*T.softmax([F.col("m")[i] for i in range(3)])).alias("p")).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-12 for r in p)


def test_first_round_is_the_newton_step(spark, vectors, tmp_dir):
    """With all rows, all columns and one leaf more, leaf values follow from gradient and curvature."""
    trees = T.fit_boosting(vectors, T.Boosting(rounds=1, step=1.0, depth=1, rows=1.0, columns=1.0), tmp_dir, 3)
    rows = vectors.select(vector_to_array("features").alias("x"), "label_idx").collect()
    x, label = np.array([r["x"] for r in rows]), np.array([r["label_idx"] for r in rows])
    m, curve = trees.sums(x), 2 / 3 * (1 - 1 / 3)
    for k in range(3):
        for value in np.unique(m[:, k]):
            inside = m[:, k] == value
            gradient = ((label[inside] == k) - 1 / 3).sum()
            assert abs(value - gradient / (curve * inside.sum() + 1.0)) < 1e-9


def test_trees_are_saved_and_loaded(spark, vectors, tmp_dir):
    trees = T.forest_trees(spark, T.fit_forest(vectors, forest(2), tmp_dir + "/f", 5))
    T.save_trees(spark, trees, tmp_dir + "/t")
    back = T.load_trees(spark, tmp_dir + "/t")
    x = np.array([r[0] for r in vectors.select(vector_to_array("features")).collect()])
    assert np.array_equal(trees.sums(x), back.sums(x))


def test_parts_are_bounded_by_nodes():
    assert T.part_size(5) == 1 << 15 and T.part_size(12) == 256 and T.part_size(30) == 16
