"""Profiling queries from the research notebooks, as grouped Spark aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.config import CORRELATION_FEATURES, RESEARCH_TIER_ORDER, TIER_MEAN_FEATURES
from tierscope.functions.buckets import superhost_label
from tierscope.functions.stats import median, quantile
from tierscope.operators.quantiles import _null_safe_join, exact_quantiles


def pct_round2(count: Column, total: Column) -> Column:
    """round(100 * count / total, 2) with exact half-to-even on the rational value.

    Integer arithmetic on hundredths of a percent avoids binary-rounding
    disagreements between engines.
    """
    num = count.cast("long") * 10000
    q = ((num - num % total) / total).cast("long")
    r = num - q * total
    up = (2 * r > total) | ((2 * r == total) & (q % 2 == 1))
    return (q + F.when(up, 1).otherwise(0)) / 100.0


def price_summary(df: DataFrame) -> DataFrame:
    """Min, q1, median, mean, q3, max of price (missing skipped) + missing count."""
    p = F.col("price_numeric")
    # Raw prices are unbounded: their quantiles come from the collapsed table, not from one map.
    q = exact_quantiles(df, [], "price_numeric", {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(F.struct("q1", "median", "q3")).scalar()
    return df.agg(F.min(p).alias("min"), F.avg(p).alias("mean"), F.max(p).alias("max"),
                  F.count_if(p.isNull()).alias("n_missing")).select(
        "min", q.getField("q1").alias("q1"), q.getField("median").alias("median"), "mean", q.getField("q3").alias("q3"), "max", "n_missing")


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column missing count and percent (2 dp); only > 0; descending.

    One aggregation computes every column's null count; the one-row
    result is unpivoted into (variable, missing_count).
    """
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot("_n", df.columns, "variable", "missing_count")
    return (long.where(F.col("missing_count") > 0)
                .select("variable", "missing_count",
                        pct_round2(F.col("missing_count"), F.col("_n")).alias("missing_percent"))
                .orderBy(F.desc("missing_percent"), "variable"))


def completeness(df: DataFrame) -> DataFrame:
    """Rows, complete rows, completeness percent (2 dp)."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    out = df.agg(F.count(F.lit(1)).alias("total_obs"), F.count_if(complete).alias("complete_cases"))
    return out.withColumn("completeness_pct", pct_round2(F.col("complete_cases"), F.col("total_obs")))


def outlier_count(df: DataFrame, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Rows with price outside [p1, p99] (exact quantiles as one scalar subquery)."""
    p = F.col("price_numeric")
    qs = exact_quantiles(df, [], "price_numeric", {"lo": lo_q, "hi": hi_q}).select(F.struct("lo", "hi")).scalar()
    return df.agg(F.count_if((p > qs.getField("hi")) | (p < qs.getField("lo"))).alias("price_outliers"))


def cardinality(df: DataFrame) -> DataFrame:
    """Distinct neighbourhoods and property types; a missing value counts as a level."""
    def n_levels(c: str) -> Column:
        return F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))
    return df.agg(n_levels("neighbourhood_cleansed").alias("n_neighbourhoods"),
                  n_levels("property_type").alias("n_property_types"))


def class_imbalance(df: DataFrame) -> DataFrame:
    """Max class share / min class share (missing tier excluded)."""
    counts = (df.where(F.col("price_category").isNotNull())
                .groupBy("price_category").agg(F.count(F.lit(1)).alias("n")))
    out = counts.agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.sum("n").alias("total"))
    return out.select(
        (F.col("max_n") / F.col("total")).alias("max_share"),
        (F.col("min_n") / F.col("total")).alias("min_share"),
        ((F.col("max_n") / F.col("total")) / (F.col("min_n") / F.col("total"))).alias("imbalance_ratio"))


def property_type_tiers(df: DataFrame, min_listings: int = 50) -> DataFrame:
    """Property type x tier counts for types with >= min_listings listings."""
    from pyspark.sql import Window
    counts = df.groupBy("property_type", "price_category").agg(F.count(F.lit(1)).alias("n"))
    return (counts.withColumn("_type_n", F.sum("n").over(Window.partitionBy("property_type")))
                  .where(F.col("_type_n") >= min_listings).drop("_type_n"))


def host_type_pivot(df: DataFrame, tiers=RESEARCH_TIER_ORDER) -> DataFrame:
    """Host type x tier counts as a wide table, missing cells 0."""
    labelled = (df.where(F.col("host_is_superhost").isNotNull())
                  .withColumn("host_type", superhost_label(F.col("host_is_superhost")))
                  .where(F.col("host_type") != "Unknown"))
    wide = labelled.groupBy("host_type").pivot("price_category", list(tiers)).count()
    return wide.fillna(0, subset=list(tiers))


def superhost_value_counts(df: DataFrame) -> DataFrame:
    """Counts per superhost value, missing included as its own group."""
    return df.groupBy("host_is_superhost").agg(F.count(F.lit(1)).alias("n"))


def tier_means(df: DataFrame) -> DataFrame:
    """Mean of eight features per tier (missing skipped)."""
    return df.groupBy("price_category").agg(*[F.avg(c).alias(n) for n, c in TIER_MEAN_FEATURES])


def tier_crosstab(df: DataFrame, column: str) -> DataFrame:
    """Row-normalised tier x column table (shares within each tier)."""
    from pyspark.sql import Window
    counts = df.groupBy("price_category", column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("price_category")))


BOX_FEATURES = ["accommodates", "bedrooms", "amenities_count", "review_scores_rating",
                "availability_365", "number_of_reviews", "distance_from_cbd"]


def box_stats(df: DataFrame, features: list[str] = BOX_FEATURES) -> DataFrame:
    """Per tier and feature: q1, median, q3, whisker ends (last values within
    1.5 IQR of the box) and the number of points beyond the whiskers.

    Pass 1 is one grouped percentile aggregate; pass 2 joins the fences
    back on (tier, feature) and takes conditional min/max/count.
    """
    long = (df.select("price_category", *[F.col(c).cast("double").alias(c) for c in features])
              .unpivot("price_category", features, "feature", "value")
              .where(F.col("value").isNotNull()))
    keys = ["price_category", "feature"]
    # Continuous features: exact quantiles without a whole-group value map.
    q = exact_quantiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    v = F.col("value")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    # Fences are one row a tier and feature; values meet them once each, with their counts.
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    return _null_safe_join(counts, F.broadcast(q), keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"))


def price_correlations(df: DataFrame, features: list[str] = CORRELATION_FEATURES) -> DataFrame:
    """Pearson correlation of price with each numeric (complete cases), descending."""
    cc = df.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()
    others = [c for c in features]
    row = cc.agg(*[F.corr("price_numeric", c).alias(c) for c in others])
    return (row.unpivot([], others, "feature", "correlation")
               .orderBy(F.desc("correlation"), "feature"))


def correlation_matrix(df: DataFrame, features: list[str] = CORRELATION_FEATURES) -> DataFrame:
    """Full Pearson matrix (complete cases) as (row, col, value): all pairs in one aggregate."""
    cc = df.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()
    cells = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.corr(a, b).alias("value")) for a in features for b in features])
    return cc.agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def top_neighbourhoods(df: DataFrame, k: int = 15) -> DataFrame:
    """The k neighbourhoods with most listings."""
    return (df.groupBy("neighbourhood_cleansed").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "neighbourhood_cleansed").limit(k))


def top_neighbourhood_prices(df: DataFrame, k: int = 15) -> DataFrame:
    """Median price and premium % for the top-k neighbourhoods (left-semi join)."""
    top = top_neighbourhoods(df, k).select("neighbourhood_cleansed")
    return (df.join(F.broadcast(top), "neighbourhood_cleansed", "left_semi")
              .groupBy("neighbourhood_cleansed")
              .agg(F.count(F.lit(1)).alias("count"), median("price_numeric").alias("median_price"),
                   (F.avg((F.col("price_category") == "Premium").cast("double")) * 100)
                   .alias("premium_pct"))
              .orderBy(F.desc("median_price"), "neighbourhood_cleansed"))


def feature_type_summary(df: DataFrame) -> DataFrame:
    """Numeric and categorical column counts, from the schema alone."""
    from pyspark.sql import types as T
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
    return df.sparkSession.createDataFrame([("numeric", numeric), ("categorical", len(df.schema.fields) - numeric)], "kind string, columns int")
