"""Running sums over an ordered table without one task for a whole group.

Rows are dealt out by sampled ranges of (group, value), so every partition
gets about as many rows, however the values are spread.  A row's sum is that
of the partitions before its own (a table of at most one row for each
partition and group) and that of the rows before it in its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.session import checkpoint_dir


def sums_before(df: DataFrame, group: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """``df`` (distinct values in a group) with, for each ``sums`` entry (name -> column), the sum over smaller values."""
    checkpoint_dir(df.sparkSession)
    # The partition a row lies in must not change between the two uses below.
    ranged = df.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(*group, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    on = [out[k].eqNullSafe(offsets[k]) for k in group] + [out["_part"] == offsets["_part"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = out.join(F.broadcast(offsets), cond)
    return joined.select(*[out[c] for c in df.columns], *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])
