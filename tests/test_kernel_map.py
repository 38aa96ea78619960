"""The random feature map: its kernel, and a ring that a straight line cannot cut out."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tierscope.plans import model as M
from tierscope.plans.kernel_map import KernelMap


def test_products_approach_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (30, 4))
    m = KernelMap(4, size=1500, gamma=0.3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    z = np.array([r["z"] for r in rows.select("i", m.columns(F.col("x")).alias("z")).orderBy("i").collect()])
    w, b = m.weights()
    assert np.allclose(z, math.sqrt(2 / 1500) * np.cos(x @ w.T + b))
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.12


def test_a_ring_is_separated(spark, tmp_dir):
    rng = random.Random(7)
    rows = []
    for i in range(500):
        a, r = rng.uniform(0, 2 * math.pi), rng.choice([0.5, 2.0]) + rng.gauss(0, 0.1)
        rows.append((i, r * math.cos(a), r * math.sin(a), rng.choice(["u", "v"]), "Budget" if r < 1.2 else "Premium"))
    table = spark.createDataFrame(rows, "id long, x double, y double, kind string, price_category string").checkpoint()
    train, test = table.where("id < 350"), table.where("id >= 350")

    def accuracy(name):
        fitted = M.fit_candidate(M.candidates()[name], train, ["x", "y"], ["kind"], classes=("Budget", "Premium"))
        out = M.predict(fitted, test, ("Budget", "Premium"))
        return fitted, out.agg(F.avg((F.col("prediction") == F.col("price_category")).cast("double"))).first()[0]

    curved, right = accuracy("rbf_svm")
    assert right > 0.95 and accuracy("linear_svm")[1] < 0.75
    M.save_model(spark, curved, tmp_dir + "/m")
    back = M.predict(M.load_model(spark, tmp_dir + "/m"), test, ("Budget", "Premium")).select("id", "prediction", "score_Budget")
    first = M.predict(curved, test, ("Budget", "Premium")).select("id", "prediction", "score_Budget")
    assert back.exceptAll(first).count() == 0
