"""A random feature map of the RBF kernel, as column expressions.

``sqrt(2 / size) * cos(w . x + b)`` with normal weights of variance ``2 *
gamma`` and uniform offsets: products of two mapped rows approach
``exp(-gamma * |x - y|^2)``, so a linear machine on them has the curved
boundary of an RBF machine.  Weights follow from the seed alone.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KernelMap:
    width: int               # of a row
    size: int = 256          # of a mapped row
    gamma: float | None = None   # one over the width if not given
    seed: int = 42

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(size x width, size), rounded so that they can be written down."""
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, np.sqrt(2 * (self.gamma or 1 / max(self.width, 1))), (self.size, self.width))
        return w.round(6), rng.uniform(0, 2 * np.pi, self.size).round(6)

    def columns(self, x: Column) -> Column:
        """An array of ``size`` features of an array of ``width`` doubles."""
        w, b = self.weights()
        table = F.array(*[F.struct(F.lit(row.tolist()).alias("w"), F.lit(float(c)).alias("b")) for row, c in zip(w, b, strict=True)])

        def feature(m):
            dot = F.aggregate(F.zip_with(x, m["w"], lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v)
            return F.cos(dot + m["b"]) * float(np.sqrt(2 / self.size))

        return F.transform(table, feature)

    def mapped(self, df: DataFrame, column: str = "features") -> DataFrame:
        """``df`` with its vector column mapped."""
        return df.withColumn(column, array_to_vector(self.columns(vector_to_array(F.col(column)))))

    def described(self) -> dict:
        return asdict(self)
