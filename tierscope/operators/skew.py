"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.session import checkpoint_dir


def join_on_hot_keys(rows: DataFrame, table: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key; ``n``: the key's rows) that no hot key slows.

    Keys that hold a ``share``-th of all rows or more are at most ``share``,
    so they are broadcast; every other key is too small to skew the shuffle.
    """
    checkpoint_dir(rows.sparkSession)
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = table.filter(F.col(n) * share >= total).coalesce(1).checkpoint()
    heavy = rows.join(F.broadcast(hot.drop(n)), key)
    light = (rows.join(F.broadcast(hot.select(key)), key, "left_anti")
             .join(table.filter(F.col(n) * share < total).drop(n), key))
    return heavy.unionByName(light)
