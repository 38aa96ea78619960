"""Classifiers that follow from sums: linear discriminant and Gaussian naive Bayes.

One aggregate gives, for each fold and class, the rows, the sums and the sums
of products of the numeric inputs, and the counts of levels.  The statistics
of a training set are the total without one fold, so fifteen fits of repeated
cross-validation come from one pass, and their models, a row each, score the
held-out rows of all folds in another.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 0.001        # share of a level that a class does not have
FLAT = 1e-9         # least variance of an input
DIGITS = 6          # of a score: sums in another order differ beyond


@dataclass
class Sums:
    """Of one class: rows, sums, sums of products, and rows of each level of each categorical input."""

    n: float
    first: np.ndarray
    second: np.ndarray
    levels: dict[tuple[str, str], float]

    def without(self, part: Sums) -> Sums:
        left = {k: v - part.levels.get(k, 0) for k, v in self.levels.items()}
        return Sums(self.n - part.n, self.first - part.first, self.second - part.second, left)

    def plus(self, part: Sums) -> Sums:
        both = {k: self.levels.get(k, 0) + part.levels.get(k, 0) for k in self.levels | part.levels}
        return Sums(self.n + part.n, self.first + part.first, self.second + part.second, both)

    @property
    def mean(self) -> np.ndarray:
        return self.first / self.n

    def scatter(self) -> np.ndarray:
        """Sums of products of deviations from the mean."""
        return self.second - np.outer(self.first, self.first) / self.n


def sums(rows: DataFrame, by: list[str], numeric: list[str], levels: Iterable[str] = (), label: str = "price_category") -> dict[tuple, dict[str, Sums]]:
    """{values of ``by``: {class: Sums}}; one row for each of them reaches the driver, and one for each level."""
    x = [F.col(c).cast("double") for c in numeric]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    found = rows.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("first"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("second"))
    out: dict[tuple, dict[str, Sums]] = {}
    for r in found.collect():
        second = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, r["second"], strict=True):
            second[i, j] = second[j, i] = v
        out.setdefault(tuple(r[b] for b in by), {})[r[label]] = Sums(float(r["n"]), np.array(r["first"]), second, {})
    levels = list(levels)
    if levels:
        long = rows.select(*by, label, *[F.col(c).cast("string").alias(c) for c in levels]).unpivot([*by, label], levels, "col", "level")
        for r in long.groupBy(*by, label, "col", "level").count().collect():
            out[tuple(r[b] for b in by)][r[label]].levels[r["col"], r["level"]] = float(r["count"])
    return out


def training_sums(folds: dict[tuple, dict[str, Sums]]) -> dict[tuple, dict[str, Sums]]:
    """For each (repeat, fold): the sums of the repeat's other folds."""
    totals: dict = {}
    for (repeat, _), classes in folds.items():
        for c, s in classes.items():
            known = totals.setdefault(repeat, {})
            known[c] = known[c].plus(s) if c in known else s
    return {(repeat, fold): {c: s.without(classes[c]) if c in classes else s for c, s in totals[repeat].items()}
            for (repeat, fold), classes in folds.items()}


# ----------------------------------------------------------------------------- models as rows
MODEL = "class string, offset double, weights array<double>, curves array<double>, centers array<double>, levels map<string,double>"


def discriminant(classes: dict[str, Sums]) -> list[tuple]:
    """Rows of MODEL, a class each: linear scores from the pooled covariance."""
    n = sum(s.n for s in classes.values())
    pooled = sum(s.scatter() for s in classes.values()) / max(n - len(classes), 1)
    out = []
    for c, s in sorted(classes.items()):
        # A singular covariance has a pseudo-inverse.
        w = np.linalg.lstsq(pooled, s.mean, rcond=None)[0] if np.linalg.matrix_rank(pooled) < len(pooled) else np.linalg.solve(pooled, s.mean)
        zero = np.zeros(len(w)).tolist()
        out.append((c, float(np.log(s.n / n) - 0.5 * s.mean @ w), w.tolist(), zero, zero, {}))
    return out


def naive_bayes(classes: dict[str, Sums]) -> list[tuple]:
    """Rows of MODEL: a normal density for each numeric input, shares for levels."""
    n, out = sum(s.n for s in classes.values()), []
    for c, s in sorted(classes.items()):
        variance = np.maximum(np.diag(s.scatter()) / max(s.n - 1, 1), FLAT)
        offset = np.log(s.n / n) - 0.5 * np.log(2 * np.pi * variance).sum()
        known = {f"{col}={level}": float(np.log(max(m / s.n, RARE))) for (col, level), m in s.levels.items()}
        out.append((c, float(offset), np.zeros(len(variance)).tolist(), (0.5 / variance).tolist(), s.mean.tolist(), known))
    return out


def _score(m: Column, x: Column, levels: list[Column]) -> Column:
    linear = F.aggregate(F.zip_with(x, m["weights"], lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    from_center = F.zip_with(x, m["centers"], lambda a, c: (a - c) * (a - c))
    curved = F.aggregate(F.zip_with(from_center, m["curves"], lambda d, c: d * c), F.lit(0.0), lambda s, v: s + v)
    shares = [F.coalesce(F.element_at(m["levels"], level), F.lit(float(np.log(RARE)))) for level in levels]
    return reduce(lambda a, b: a + b, shares, m["offset"] + linear - curved)


def predictions(rows: DataFrame, models: dict[tuple, list[tuple]], by: list[tuple[str, str]], numeric: list[str], levels: Iterable[str] = (),
                classes: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """``keep``, prediction and score_<class> of each row by the model of its ``by`` values (name, type); a class that a model lacks scores 0."""
    classes = list(classes)
    spark = rows.sparkSession
    one = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in MODEL.split(', '))}>>"
    if by:
        data = [(*key, [tuple(r) for r in fitted]) for key, fitted in models.items()]
        table = spark.createDataFrame(data, ", ".join([*[f"{n} {t}" for n, t in by], f"models {one}"]))
        # One row a model: folds x repeats of them.
        joined = rows.join(F.broadcast(table), [n for n, _ in by])
    else:   # one model: written down
        def known(levels):
            return F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]).cast("map<string,double>")

        joined = rows.withColumn("models", F.array(*[F.struct(*[F.lit(v).alias(n.split()[0]) for n, v in zip(MODEL.split(", "), r[:-1], strict=False)],
                                                              known(r[-1]).alias("levels")) for r in models[()]]))
    x = F.array(*[F.col(c).cast("double") for c in numeric])
    named = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in levels]
    scored = joined.withColumn("_s", F.transform("models", lambda m: F.struct(m["class"].alias("class"), _score(m, x, named).alias("s"))))
    top = F.array_max(F.transform("_s", lambda v: v["s"]))
    scored = scored.withColumn("_e", F.transform("_s", lambda v: F.struct(v["class"].alias("class"), F.exp(v["s"] - top).alias("e"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v["e"])

    def share(c):
        mine = F.filter("_e", lambda v: v["class"] == c)
        return F.round(F.coalesce(F.get(mine, F.lit(0))["e"], F.lit(0.0)) / total, DIGITS)

    out = scored.select(*keep, F.array(*[share(c) for c in classes]).alias("_p"))
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("_p", F.array_max("_p")).cast("int"))
    return out.select(*keep, best.alias("prediction"), *[F.col("_p")[i].alias(f"score_{c}") for i, c in enumerate(classes)])
