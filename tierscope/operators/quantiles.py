"""Exact grouped quantiles that never hold a whole group in one buffer.

``percentile``/``median`` keep a value->count map per group and merge it on
one reducer: fine for bounded-support columns (prices), not for continuous
columns where one large group can have as many distinct values as rows.
Here the work is split:

1. collapse to (group, value, count): a hot value becomes one row, and the
   shuffle key includes the value, so a hot group spreads over many tasks;
2. per group min/max and a linear bucket of 2^bits per group; counts per
   (group, bucket) form a small table whose running sum gives, for each
   bucket, the number of rows in lower buckets;
3. the 0-based ranks floor((n-1)q) and ceil((n-1)q) are located in their
   buckets, and only the distinct values of those buckets are ranked.

Interpolation is the linear (type 7) rule in the form the reference's
tools evaluate it: v_lo + (v_hi - v_lo) * (pos - floor(pos)).  Spark's
``percentile`` writes the same rule as a weighted sum, which can differ in
the last bit for non-integer values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.session import checkpoint_dir


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float],
                    bits: int = 16) -> DataFrame:
    """One row per group: ``keys`` + one column per entry of ``qs`` (name -> q).

    With no keys the whole frame is one group (a constant key is added so
    every join stays an equi-join).
    """
    if not keys:
        out = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, qs, bits)
        return out.drop("_all")
    nb = 1 << bits
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # Stats, buckets and candidates all read the collapsed table: it is made once.
    checkpoint_dir(df.sparkSession)
    vc = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).checkpoint()
    stats = vc.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                  F.sum("_c").alias("_n"))
    vb = _null_safe_join(vc, stats, keys).withColumn(
        "_b", F.when(F.col("_hi") > F.col("_lo"),
                     F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * nb),
                             F.lit(nb - 1))).otherwise(F.lit(0)).cast("long"))
    per_b = vb.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("_before", F.coalesce(F.sum("_bc").over(w), F.lit(0)))
    # Target ranks: for each quantile the floor and ceil of (n - 1) * q.
    targets = F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(which).alias("which"),
                 ((F.col("_n") - 1) * F.lit(float(q))).alias("pos"))
        for name, q in qs.items() for which in ("lo", "hi")])
    t = per_b.select("*", F.explode(targets).alias("_t")).select(
        *keys, "_b", "_bc", "_before", F.col("_t.q").alias("_q"), F.col("_t.which").alias("_which"),
        F.col("_t.pos").alias("_pos"))
    t = t.withColumn("_rank", F.when(F.col("_which") == "lo", F.floor("_pos")).otherwise(F.ceil("_pos"))
                     .cast("long"))
    t = t.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_bc")))
    # Join on keys (null-safe) + bucket: only the located buckets' values survive.
    tk = t.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_b").alias("_t_b"),
                  "_before", "_q", "_which", "_pos", "_rank")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys],
                  F.col("_b") == F.col("_t_b"))
    cand = vb.select(*keys, "_b", "_v", "_c").join(tk, cond).drop(*[f"_t_{k}" for k in keys], "_t_b")
    wi = Window.partitionBy(*keys, "_b", "_q", "_which").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0)
    cand = cand.withColumn("_upto", F.col("_before") + F.sum("_c").over(wi))
    hit = cand.where((F.col("_upto") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    # One aggregation per group: the located floor/ceil values and position of every quantile.
    aggs = []
    for name in qs:
        is_q = F.col("_q") == name
        aggs += [F.max(F.when(is_q & (F.col("_which") == "lo"), F.col("_v"))).alias(f"_lo_{name}"),
                 F.max(F.when(is_q & (F.col("_which") == "hi"), F.col("_v"))).alias(f"_hi_{name}"),
                 F.max(F.when(is_q, F.col("_pos"))).alias(f"_pos_{name}")]
    wide = hit.groupBy(*keys).agg(*aggs)
    out = []
    for name in qs:
        vlo, vhi, pos = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_pos_{name}")
        lo_r, hi_r = F.floor(pos), F.ceil(pos)
        out.append(F.when((hi_r == lo_r) | (vlo == vhi), vlo)
                    .otherwise(vlo + (vhi - vlo) * (pos - lo_r)).alias(name))
    # Every group with a non-null value has n >= 1, so every group is present here.
    return wide.select(*keys, *out)
