"""Exact stratified hold-out splits and k-fold assignment without single-task windows.

Rows are ordered inside their class by a seeded hash of the id.
A plain ``row_number() over (partition by label)`` would put a whole class
(possibly a third of the data) into one task, so the rank is computed in
two levels:

1. the top ``bits`` of the hash form a bucket; counts per (class, bucket)
   are a small table (classes x 2^bits rows) whose running sum gives the
   number of class rows in lower buckets;
2. a window partitioned by (class, bucket) ranks rows inside one bucket.

rank = rows in lower buckets + rank inside the bucket.  The result is the
exact rank a global sort would give, computed with only small sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.config import CONFIG
from tierscope.functions.hashing import HASH_BITS, stable_hash


def class_ranks(df: DataFrame, label: str, key: str = "id", seed: int = CONFIG.model.random_state,
                bits: int = CONFIG.model.split_bucket_bits) -> DataFrame:
    """Adds ``_rank`` (1-based, exact, within class) and ``_class_n``."""
    hashed = df.withColumn("_h", stable_hash(key, seed)).withColumn("_b", F.shiftright(F.col("_h"), HASH_BITS - bits))
    counts = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    w_before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        label, "_b",
        F.coalesce(F.sum("_bn").over(w_before), F.lit(0)).alias("_before"),
        F.sum("_bn").over(Window.partitionBy(label)).alias("_class_n"))
    w_in = Window.partitionBy(label, "_b").orderBy("_h", key)
    ranked = hashed.withColumn("_in", F.row_number().over(w_in))
    # offsets has at most (#classes x 2^bits) rows: a size bound by construction.
    return (ranked.join(F.broadcast(offsets), [label, "_b"])
                  .withColumn("_rank", F.col("_before") + F.col("_in"))
                  .drop("_h", "_b", "_in", "_before"))


def test_allocation(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Per-class test counts: total ceil(test_size * n), split proportionally;
    leftover rows go to the classes with the largest fractional parts
    (ties by label).  Works on the tiny per-class count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))
    everything = Window.partitionBy(F.lit(1))
    n = F.sum("_n_c").over(everything)
    out = counts.withColumn("_n_test", F.ceil(F.lit(test_size) * n))
    out = out.withColumn("_cont", F.col("_n_c") * F.col("_n_test") / n)
    out = out.withColumn("_fl", F.floor("_cont")).withColumn("_rem", F.col("_cont") - F.col("_fl"))
    out = out.withColumn("_short", F.col("_n_test") - F.sum("_fl").over(everything))
    pick = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_rem"), F.asc(label)))
    return out.select(label, (F.col("_fl") + F.when(pick <= F.col("_short"), 1).otherwise(0))
                      .cast("long").alias("_t_c"))


def stratified_split(df: DataFrame, label: str = "price_category", test_size: float = CONFIG.model.test_size,
                     seed: int = CONFIG.model.random_state, key: str = "id",
                     folds: int | None = CONFIG.model.cv_folds) -> DataFrame:
    """Adds ``split`` ('train'/'test') with exact per-class test counts and, for
    training rows, ``fold`` = (rank within the class's training rows - 1) % folds."""
    ranked = class_ranks(df, label, key, seed)
    alloc = test_allocation(df, label, test_size)
    out = ranked.join(F.broadcast(alloc), label)
    is_test = F.col("_rank") <= F.col("_t_c")
    out = out.withColumn("split", F.when(is_test, "test").otherwise("train"))
    if folds:
        out = out.withColumn("fold", F.when(~is_test, ((F.col("_rank") - F.col("_t_c") - 1) % folds)
                                            .cast("int")))
    return out.drop("_rank", "_class_n", "_t_c")


def split_summary(split_df: DataFrame, label: str = "price_category") -> DataFrame:
    """Rows per (split, class), share of the split, and share of all rows."""
    counts = split_df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    return (counts.withColumn("share_in_split", F.col("n") / F.sum("n").over(Window.partitionBy("split")))
                  .withColumn("share_of_all", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))
