"""Models and scores that outlive a process; importance of a rule and of a model."""

import random

import pytest
from pyspark.sql import functions as F

from tierscope.plans import importance as IMP
from tierscope.plans.kept import fingerprint, kept, kept_table


def rows(spark, n=50, label="b"):
    return spark.createDataFrame([(i, i % 3, label) for i in range(n)], "id long, x int, label string")


def test_fingerprint_tells_rows_and_settings_apart(spark):
    a = rows(spark)
    assert fingerprint(a, 1) == fingerprint(a.repartition(7).orderBy(F.desc("id")).select("label", "id", "x"), 1)
    others = [fingerprint(a, 2), fingerprint(a.unionByName(a.limit(1)), 1), fingerprint(rows(spark, 49), 1), fingerprint(rows(spark, label="c"), 1),
              fingerprint(a.withColumnRenamed("x", "y"), 1), fingerprint(a.withColumn("x", F.col("x").cast("long")), 1)]
    assert len({fingerprint(a, 1), *others}) == 7


def test_made_once_and_read_afterwards(spark, tmp_dir):
    made = []

    def make():
        made.append(1)
        return rows(spark, 5)

    for _ in range(3):
        assert kept_table(spark, tmp_dir, "scores", "k1", make).count() == 5
    kept_table(spark, tmp_dir, "scores", "k2", make)
    assert len(made) == 2


def test_an_entry_cut_off_is_made_again(spark, tmp_dir):
    def broken(folder):
        rows(spark, 3).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        kept(spark, tmp_dir, "scores", "k", broken, spark.read.parquet)
    assert kept_table(spark, tmp_dir, "scores", "k", lambda: rows(spark, 4)).count() == 4


def brute_f1(pairs, classes):
    f1 = []
    for c in classes:
        tp = sum(a == b == c for a, b in pairs)
        n = sum(a == c for a, _ in pairs) + sum(b == c for _, b in pairs)
        f1.append(2 * tp / n if n else 0.0)
    return sum(f1) / len(f1)


def test_importance_of_a_rule_by_hand(spark):
    rng = random.Random(2)
    table = [(i, rng.choice(["Budget", "Mid-Market", "Premium"]), rng.randint(0, 9), rng.choice(["u", "v", None]), rng.random()) for i in range(300)]
    test = spark.createDataFrame(table, "id long, price_category string, size int, kind string, idle double")
    rule = "CASE WHEN size > 6 THEN 'Premium' WHEN kind = 'u' THEN 'Mid-Market' ELSE 'Budget' END"

    def judge(size, kind):
        return "Premium" if size > 6 else "Mid-Market" if kind == "u" else "Budget"

    got = {r["feature"]: r for r in IMP.score_importance(lambda d: d.withColumn("prediction", F.expr(rule)), ["size", "kind", "idle"], test, repeats=3).collect()}
    assert abs(got["idle"]["importance"]) < 1e-12 and got["idle"]["importance_std"] < 1e-12
    copies = IMP.permuted_copies(test, ["size", "kind", "idle"], 3, 42, "id").collect()
    assert len(copies) == 300 * 3 * 3
    own = {r[0]: r for r in table}
    reference = brute_f1([(r[1], judge(r[2], r[3])) for r in table], IMP.TIER_ORDER)
    for feature, place in (("size", 2), ("kind", 3)):
        drops = []
        for r in range(3):
            part = [c for c in copies if c["_repeat"] == r and c["_feature"] == feature]
            # A permutation: the same values, each at another row; all other columns are the row's own.
            assert sorted(str(c[feature]) for c in part) == sorted(str(x[place]) for x in table)
            assert all(c["idle"] == own[c["id"]][4] for c in part)
            drops.append(reference - brute_f1([(c["price_category"], judge(c["size"], c["kind"])) for c in part], IMP.TIER_ORDER))
        assert abs(got[feature]["importance"] - sum(drops) / 3) < 1e-12


def test_importance_of_a_logistic_regression_scores_no_copy(spark, monkeypatch):
    """Every copy counted from sums is what scoring it says."""
    from tierscope.plans import model as M
    rows = []
    for i in range(300):
        tier = ("Budget", "Mid-Market", "Premium")[(i * 7 + (i % 11 > 5)) % 3]
        size = None if i % 17 == 0 else float("BMP".index(tier[0]) * 2 + i * 13 % 5)
        rows.append((i, tier, size, float(i * 31 % 9), "rare" if i >= 298 else None if i % 23 == 0 else "xyz"[(i + len(tier)) % 3], "uv"[i % 2]))
    data = spark.createDataFrame(rows, "id long, price_category string, size double, idle double, kind string, side string")
    train, test = data.filter("id < 200"), data.filter("id >= 200")   # a level of the test rows is unseen
    model = M.fit_candidate(M.candidates()["logistic_regression"], train, ["size", "idle"], ["kind", "side"])
    inputs = ["size", "idle", "kind", "side"]
    want = {r["feature"]: r for r in IMP.score_importance(lambda d: M.predict(model, d), inputs, test, repeats=3).collect()}
    scored = []
    monkeypatch.setattr(IMP, "predict", lambda m, d: scored.append(d.count()) or M.predict(m, d))
    got = {r["feature"]: r for r in IMP.permutation_importance(model, test, repeats=3).collect()}
    assert scored == [100] and set(got) == set(inputs)
    for c in inputs:
        assert abs(got[c]["importance"] - want[c]["importance"]) < 1e-12 and abs(got[c]["importance_std"] - want[c]["importance_std"]) < 1e-12
    assert want["size"]["importance"] > 0.05
    assert IMP.additive(M.fit_candidate(M.candidates()["baseline_majority"], train, ["size", "idle"], ["kind", "side"])) is None
