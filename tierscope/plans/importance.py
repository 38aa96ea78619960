"""Permutation importance on input columns as one distributed job.

The test rows get a position by hash, and for each repeat a donor rank by
another hash: the row at position p receives the value of the row whose donor
rank is p.  Every (repeat, feature) copy of the test split, with only that
feature replaced, is scored in a single pass; macro F1 per (repeat, feature)
comes from grouped confusion counts.  Importance is F1 on the intact split
minus the mean permuted F1, sorted descending.

The margins of a logistic regression are sums over its inputs, so a copy needs
no scoring of its own: the row's margins, less what its value of the feature
adds, plus what the donor's adds.  Rows and donors meet once a repeat, as one
number an input, and a task counts the predictions of every copy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.config import TIER_ORDER
from tierscope.operators.split import class_ranks
from tierscope.plans.model import FittedModel, category_labels, predict
from tierscope.session import checkpoint_dir

POSITION, DONOR = 1000, 2000   # added to the seed


def _macro_f1_by(scored: DataFrame, keys: list[str], classes=TIER_ORDER) -> DataFrame:
    """Macro F1 (0 for undefined classes) per group of ``keys``."""
    return _macro_f1_of(scored.groupBy(*keys, F.col("price_category").alias("label"), F.col("prediction").alias("pred")).agg(F.count(F.lit(1)).alias("n")), keys, classes)


def _macro_f1_of(cells: DataFrame, keys: list[str], classes=TIER_ORDER) -> DataFrame:
    """The same of counted cells: keys, label, pred, n."""
    def f1(c):
        def n(condition):
            return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

        hit, is_label, is_pred = n((F.col("label") == c) & (F.col("pred") == c)), n(F.col("label") == c), n(F.col("pred") == c)
        return F.when(is_label + is_pred > 0, 2 * hit / (is_label + is_pred)).otherwise(F.lit(0.0))

    return cells.groupBy(*keys).agg((reduce(lambda a, b: a + b, [f1(c) for c in classes]) / len(classes)).alias("f1_macro"))


def _ranked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return class_ranks(rows.withColumn("_all", F.lit(1)), "_all", key, seed=seed).drop("_all", "_class_n")


def permuted_copies(test: DataFrame, inputs: list[str], repeats: int, seed: int, key: str) -> DataFrame:
    """Every row once for each (_repeat, _feature), that feature's value taken from the row's donor."""
    checkpoint_dir(test.sparkSession)
    base = _ranked(test.select(key, "price_category", *inputs), key, seed + POSITION).withColumnRenamed("_rank", "_pos").checkpoint()
    donors = [_ranked(base.select(key, *inputs), key, seed + DONOR + r).select(
        F.col("_rank").alias("_pos"), F.lit(r).alias("_repeat"), F.struct(*inputs).alias("_donor")) for r in range(repeats)]
    rows = base.join(reduce(DataFrame.unionByName, donors), "_pos").drop("_pos")
    rows = rows.withColumn("_feature", F.explode(F.array(*[F.lit(c) for c in inputs])))
    return rows.select(key, "price_category", "_repeat", "_feature", *[
        F.when(F.col("_feature") == c, F.col(f"_donor.{c}")).otherwise(F.col(c)).alias(c) for c in inputs])


def score_importance(score: Callable[[DataFrame], DataFrame], inputs: list[str], test: DataFrame, repeats: int = 5, seed: int = 42,
                     key: str = "id") -> DataFrame:
    """(feature, importance, importance_std) of whatever adds ``prediction`` to rows with the ``inputs``."""
    per = _macro_f1_by(score(permuted_copies(test, inputs, repeats, seed, key)), ["_repeat", "_feature"])
    return _importances(per, score, inputs, test, key)


def _importances(per: DataFrame, score: Callable[[DataFrame], DataFrame], inputs: list[str], test: DataFrame, key: str) -> DataFrame:
    """``per``: macro F1 of each (_repeat, _feature)."""
    whole = score(test.select(key, "price_category", *inputs)).withColumn("_k", F.lit(1))
    ref = _macro_f1_by(whole, ["_k"]).select(F.first("f1_macro")).scalar()
    return (per.groupBy(F.col("_feature").alias("feature"))
               .agg((ref - F.avg("f1_macro")).alias("importance"),
                    F.stddev_pop("f1_macro").alias("importance_std"))
               .orderBy(F.desc("importance"), "feature"))


@dataclass
class Additive:
    """What each input adds to the margins: a numeric one its value times ``slopes``, a categorical one its level's row of a table."""

    offsets: np.ndarray         # a class
    slopes: np.ndarray          # numeric inputs x classes
    tables: list[np.ndarray]    # levels x classes; the last row is the unseen level's

    def parts(self, values: np.ndarray) -> np.ndarray:
        """Rows x inputs x classes, of rows x inputs: scaled numbers, then places of levels."""
        n = len(self.slopes)
        levels = [t[values[:, n + i].astype(np.int64)][:, None, :] for i, t in enumerate(self.tables)]
        return np.concatenate([values[:, :n, None] * self.slopes, *levels], axis=1)

    def predictions(self, own: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """Rows x inputs: the class of the copy whose input is the donor's, the first among equals."""
        mine = self.parts(own)
        return ((mine.sum(axis=1) + self.offsets)[:, None, :] - mine + self.parts(donor)).argmax(axis=2)


def additive(model: FittedModel) -> Additive | None:
    """The sums of a fitted multinomial logistic regression; None of any other model."""
    head = model.pipeline.stages[-1]
    if not isinstance(head, LogisticRegressionModel) or head.coefficientMatrix.numRows == 1:   # binomial
        return None
    weights, at, tables, vocabulary = head.coefficientMatrix.toArray().T, len(model.numeric), [], category_labels(model)
    for c in model.categorical:
        width = len(vocabulary[c])   # an unseen level is no column
        tables.append(np.concatenate([weights[at:at + width], np.zeros((1, weights.shape[1]))]))
        at += width
    return Additive(head.interceptVector.toArray(), weights[:len(model.numeric)], tables)


def additive_cells(model: FittedModel, sums: Additive, test: DataFrame, repeats: int, seed: int, key: str, classes=TIER_ORDER) -> DataFrame:
    """(_repeat, _feature, label, pred, n): the predictions of all copies of ``permuted_copies``, counted."""
    inputs = model.numeric + model.categorical
    checkpoint_dir(test.sparkSession)
    placed = PipelineModel(model.pipeline.stages[:-1]).transform(test.select(key, "price_category", *inputs))
    values = F.array(*[F.col(f"num__{c}").cast("double") for c in model.numeric], *[F.col(f"idx__{c}") for c in model.categorical])
    base = _ranked(placed.select(key, "price_category", values.alias("_own")), key, seed + POSITION).withColumnRenamed("_rank", "_pos").checkpoint()
    donors = [_ranked(base.select(key, F.col("_own").alias("_donor")), key, seed + DONOR + r).select(
        F.col("_rank").alias("_pos"), F.lit(r).alias("_repeat"), "_donor") for r in range(repeats)]
    rows = base.select("_pos", F.col("price_category").alias("label"), "_own").join(reduce(DataFrame.unionByName, donors), "_pos")

    def run(batches):
        import pyarrow as pa

        def matrix(column):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(inputs))

        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pred = sums.predictions(matrix(batch.column("_own")), matrix(batch.column("_donor")))
            repeat, label = batch.column("_repeat").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
            for r in np.unique(repeat).tolist():
                for x in dict.fromkeys(label.tolist()):
                    some = pred[(repeat == r) & (label == x)]
                    n = np.stack([(some == k).sum(axis=0) for k in range(len(classes))], axis=1)
                    found[r, x] = found.get((r, x), 0) + n
        cells = [(r, inputs[i], x, classes[k], int(n[i, k])) for (r, x), n in found.items() for i, k in zip(*np.nonzero(n))]
        names = ["_repeat", "_feature", "label", "pred", "n"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(kinds)], names)

    cells = rows.select("_repeat", "label", "_own", "_donor").mapInArrow(run, "_repeat int, _feature string, label string, pred string, n long")
    return cells.groupBy("_repeat", "_feature", "label", "pred").agg(F.sum("n").alias("n"))


def permutation_importance(model: FittedModel, test: DataFrame, repeats: int = 5, seed: int = 42,
                           key: str = "id") -> DataFrame:
    inputs, sums = model.numeric + model.categorical, additive(model)

    def score(rows):
        return predict(model, rows)

    if sums is None:
        return score_importance(score, inputs, test, repeats, seed, key)
    per = _macro_f1_of(additive_cells(model, sums, test, repeats, seed, key), ["_repeat", "_feature"])
    return _importances(per, score, inputs, test, key)
