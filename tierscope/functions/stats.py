"""Aggregate helpers: medians/percentiles and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def median(c) -> Column:
    """Linear-interpolated median that skips nulls.

    Exact: one value->count map per group, merged map-side.  For columns of
    bounded support; continuous ones take ``operators.quantiles``.
    """
    return F.median(c)


def quantile(c, q: float) -> Column:
    return F.percentile(c, F.lit(q))


def share(cond: Column) -> Column:
    """Mean of a boolean condition (null counts as false)."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
