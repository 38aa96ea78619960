"""Imputation: constants, global medians, derived values; fitted imputers for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_constants(df: DataFrame, values: dict) -> DataFrame:
    """Constant imputation (e.g. reviews/month -> 0, superhost -> False)."""
    present = {k: v for k, v in values.items() if k in df.columns}
    return df.select(*[
        F.coalesce(F.col(c), F.lit(present[c])).alias(c) if c in present else F.col(c)
        for c in df.columns
    ])


def fill_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Global-median imputation; the medians are one scalar subquery (a struct)."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    med = df.select(F.struct(*[F.median(c).alias(c) for c in cols])).scalar()
    return df.select(*[
        F.coalesce(F.col(c), med.getField(c)).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def fill_derived(df: DataFrame, column: str, expr: Column) -> DataFrame:
    """Derived imputation, e.g. bedrooms -> ceil(accommodates / 2)."""
    return df.withColumn(column, F.coalesce(F.col(column), expr.cast(df.schema[column].dataType)))
