"""Classifiers from sums: against numpy on the rows themselves, and folds against refits."""

import random

import numpy as np
import pytest

from tierscope.config import RESEARCH_TIER_ORDER
from tierscope.plans import closed_forms as CF
from tierscope.plans import research_model as RM


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    kinds = {c: ["u", "v", "w"] for c in RM.CATEGORICAL}
    rows = []
    for i in range(240):
        c = rng.choice(RESEARCH_TIER_ORDER)
        shift = RESEARCH_TIER_ORDER.index(c)
        room = rng.choice(["u", "v"] if shift < 2 else ["v", "w"])
        rows.append((f"r{i:03}", c, *[rng.gauss(shift * (j % 3), 1 + j) for j in range(len(RM.NUMERIC))],
                     *[room if k == "room_type" else rng.choice(kinds[k]) for k in RM.CATEGORICAL]))
    schema = "row_key string, price_category string, " + ", ".join([f"{c} double" for c in RM.NUMERIC] + [f"{c} string" for c in RM.CATEGORICAL])
    return spark.createDataFrame(rows, schema).checkpoint()


def log_scores(name, train, rows):
    """Straight from the definitions, over the rows."""
    out = {}
    x, y = rows[RM.NUMERIC].to_numpy(), train[RM.NUMERIC].to_numpy()
    label = train["price_category"].to_numpy(str)
    pooled = sum((y[label == c] - y[label == c].mean(0)).T @ (y[label == c] - y[label == c].mean(0)) for c in set(label)) / (len(y) - len(set(label)))
    for c in RESEARCH_TIER_ORDER:
        mine = y[label == c]
        prior = np.log(len(mine) / len(y))
        if name == "lda":
            d = x - mine.mean(0)
            out[c] = prior - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(pooled), d)
        else:
            sd = mine.std(0, ddof=1)
            density = (-0.5 * ((x - mine.mean(0)) / sd) ** 2 - np.log(sd * np.sqrt(2 * np.pi))).sum(1)
            share = train[train["price_category"] == c]["room_type"].value_counts(normalize=True)
            out[c] = prior + density + np.log([max(share.get(v, 0), CF.RARE) for v in rows["room_type"]])
    s = np.stack([out[c] for c in RESEARCH_TIER_ORDER], 1)
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@pytest.mark.parametrize("name", ["lda", "naive_bayes"])
def test_scores_are_those_of_the_definition(table, name):
    train, test = table.filter("row_key < 'r180'"), table.filter("row_key >= 'r180'")
    got = RM.closed_form_test(train, test, name).toPandas().sort_values("row_key")
    want = log_scores(name, train.toPandas(), test.toPandas().sort_values("row_key"))
    assert np.allclose(got[[f"score_{c}" for c in RESEARCH_TIER_ORDER]].to_numpy(), want, atol=2e-6)
    assert got["prediction"].tolist() == [RESEARCH_TIER_ORDER[i] for i in want.argmax(1)]
    assert (got["prediction"].to_numpy() == got["label"].to_numpy()).mean() > 0.45   # a third at random


def test_sums_without_a_fold_are_those_of_the_other_rows(table):
    rows = RM.repeated_folds(table).toPandas()
    found = CF.training_sums(RM.fold_sums(table))
    assert len(found) == len(RM.REPEAT_SEEDS) * RM.FOLDS
    for (r, f), classes in found.items():
        part = rows[(rows["repeat"] == r) & (rows["fold"] != f)]
        for c, s in classes.items():
            x = part[part["price_category"] == c][RM.NUMERIC].to_numpy()
            assert s.n == len(x) and np.allclose(s.mean, x.mean(0)) and np.allclose(s.scatter(), (x - x.mean(0)).T @ (x - x.mean(0)))
            counts = part[part["price_category"] == c]["room_type"].value_counts()
            assert {k[1]: v for k, v in s.levels.items() if v} == counts.to_dict()


def test_fifteen_fits_equal_refits(table):
    rows = RM.repeated_folds(table).toPandas()
    got = RM.repeated_predictions(table).toPandas()
    assert len(got) == 3 * len(rows)
    for name in ("lda", "naive_bayes"):
        for r, f in ((0, 0), (1, 3), (2, 4)):
            held = rows[(rows["repeat"] == r) & (rows["fold"] == f)].sort_values("row_key")
            want = log_scores(name, rows[(rows["repeat"] == r) & (rows["fold"] != f)], held)
            mine = got[(got["model"] == name) & (got["repeat"] == r) & (got["fold"] == f)].sort_values("row_key")
            assert mine["prediction"].tolist() == [RESEARCH_TIER_ORDER[i] for i in want.argmax(1)]
    scores = RM.repeated_scores(table).toPandas()
    assert len(scores) == 45 and scores.groupby(["model", "repeat"])["n"].sum().eq(240).all()
    one = got[(got["model"] == "lda") & (got["repeat"] == 0) & (got["fold"] == 0)]
    mine = scores[(scores["model"] == "lda") & (scores["repeat"] == 0) & (scores["fold"] == 0)].iloc[0]
    assert abs(mine["accuracy"] - (one["label"].to_numpy() == one["prediction"].to_numpy()).mean()) < 1e-12


def test_a_constant_input_does_not_break_the_fit(spark, table):
    from pyspark.sql import functions as F
    flat = table.withColumn(RM.NUMERIC[0], F.lit(3.0)).withColumn(RM.NUMERIC[1], F.col(RM.NUMERIC[2]))
    for name in ("lda", "naive_bayes"):
        out = RM.closed_form_test(flat, flat.limit(20), name).toPandas()
        scores = out[[f"score_{c}" for c in RESEARCH_TIER_ORDER]].to_numpy()
        assert np.isfinite(scores).all() and np.allclose(scores.sum(1), 1, atol=1e-5)
