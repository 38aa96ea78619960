"""Market questions over the feature table (dashboard panels as Spark plans).

Every function takes the (filtered) feature DataFrame and returns a small
aggregate.  Scalars such as the city median enter as scalar subqueries,
never as cross joins or driver round trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope.config import (
    CONFIG, DISTANCE_BAND_EDGES, DISTANCE_BAND_LABELS, DISTANCE_RING_EDGES,
    DISTANCE_RING_LABELS, TIER_MIDPOINTS, TIER_ORDER, Config,
)
from tierscope.functions.amenities import flag_column
from tierscope.functions.buckets import right_closed_bins
from tierscope.functions.hashing import stable_hash
from tierscope.functions.stats import median, quantile, share
from tierscope.operators.prefix import sums_before
from tierscope.operators.quantiles import _null_safe_join, exact_quantiles



def _price():
    return F.col("price_numeric")


def tier_dimension(df: DataFrame) -> DataFrame:
    """The fixed tier list (3 rows) with its sort position."""
    return df.sparkSession.createDataFrame(
        [(i, t) for i, t in enumerate(TIER_ORDER)], "tier_pos int, price_category string")


# --------------------------------------------------------------------------- filters
def default_price_range(features: DataFrame) -> Column:
    """struct(lo, hi): int(min price) and int(exact p99), as one scalar subquery."""
    return features.select(F.struct(
        F.floor(F.min(_price())).cast("long").alias("lo"),
        F.floor(F.percentile(_price(), F.lit(0.99))).cast("long").alias("hi"))).scalar()


def market_view(features: DataFrame, rooms: list[str] | None = None,
                price_range: tuple[float, float] | None = None,
                tiers: list[str] | None = None) -> DataFrame:
    """Room-type IN, price BETWEEN, tier IN; an empty selection means 'all'.

    Defaults follow the dashboard: every non-null room type, price between
    int(min) and int(p99) (so the top ~1 % is outside the default view),
    every tier.
    """
    room_cond = F.col("room_type").isin(rooms) if rooms else F.col("room_type").isNotNull()
    if price_range is None:
        rng = default_price_range(features)
        lo, hi = rng.getField("lo"), rng.getField("hi")
    else:
        lo, hi = F.lit(price_range[0]), F.lit(price_range[1])
    tier_cond = F.col("price_category").isin(tiers or TIER_ORDER)
    return features.filter(room_cond & _price().between(lo, hi) & tier_cond)


def slice_equal(df: DataFrame, **equals) -> DataFrame:
    """Equality slice, e.g. neighbourhood then room type."""
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def has_rows(df: DataFrame) -> bool:
    """Empty-result guard for a filtered view (one short job: stops at the first row)."""
    return not df.isEmpty()


def levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct sorted non-null levels for pick lists."""
    return df.select(column).dropna().distinct().orderBy(column)


def clip_upper(c: Column, cap: Column) -> Column:
    return F.when(c > cap, cap).otherwise(c)


def keep_at_most_quantile(df: DataFrame, q: float = 0.98) -> DataFrame:
    cap = df.select(F.percentile(_price(), F.lit(q))).scalar()
    return df.filter(_price() <= cap)


# --------------------------------------------------------------------------- aggregates
def tier_counts(df: DataFrame) -> DataFrame:
    """Count and share per tier in fixed order; absent tiers show 0."""
    counts = df.groupBy("price_category").agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return (tier_dimension(df).join(counts, "price_category", "left")
            .select("tier_pos", "price_category", F.coalesce("n", F.lit(0)).alias("n"))
            .select("tier_pos", "price_category", "n",
                    F.try_divide(F.col("n"), total).alias("share")))


def median_by_distance_band(df: DataFrame) -> DataFrame:
    """Median price per (0,2] (2,5] ... (40,inf) km band; empty bands absent."""
    band = right_closed_bins(F.col("distance_from_cbd_km"), DISTANCE_BAND_EDGES, DISTANCE_BAND_LABELS)
    return (df.select(band.alias("band"), _price()).where(F.col("band").isNotNull())
              .groupBy("band").agg(median(_price()).alias("median_price"),
                                   F.count(F.lit(1)).alias("n")))


def median_by_distance_ring(df: DataFrame) -> DataFrame:
    """Median price per ring (0,2] ... (20,100]; beyond 100 km in no ring."""
    ring = right_closed_bins(F.col("distance_from_cbd_km"), DISTANCE_RING_EDGES, DISTANCE_RING_LABELS)
    return (df.select(ring.alias("ring"), _price()).where(F.col("ring").isNotNull())
              .groupBy("ring").agg(median(_price()).alias("median_price")))


def central_premium(df: DataFrame) -> DataFrame:
    """E5: median within 5 km vs from 15 km; premium = near/far - 1 (null if undefined)."""
    d = F.col("distance_from_cbd_km")
    out = df.agg(median(F.when(d <= 5, _price())).alias("near_median"),
                 median(F.when(d >= 15, _price())).alias("far_median"))
    return out.withColumn("premium", F.when(
        F.col("near_median").isNotNull() & F.col("far_median").isNotNull() & (F.col("far_median") != 0),
        F.col("near_median") / F.col("far_median") - 1))


def kpi_band(df: DataFrame) -> DataFrame:
    """Listings, median price, neighbourhoods, premium share, superhost mean, median rating."""
    return df.agg(
        F.count(F.lit(1)).alias("listings"),
        median(_price()).alias("median_price"),
        F.countDistinct("neighbourhood_cleansed").alias("neighbourhoods"),
        share(F.col("price_category") == "Premium").alias("premium_share"),
        F.avg("host_is_superhost").alias("superhost_share"),
        median("review_scores_rating").alias("median_rating"))


def header_totals(df: DataFrame) -> DataFrame:
    """Rows, distinct neighbourhoods, median price."""
    return df.agg(F.count(F.lit(1)).alias("listings"),
                  F.countDistinct("neighbourhood_cleansed").alias("neighbourhoods"),
                  median(_price()).alias("median_price"))


def neighbourhood_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("neighbourhood_cleansed").agg(
        median(_price()).alias("median_price"), F.count("id").alias("listings"))


def priciest_neighbourhoods(df: DataFrame, min_listings: int = 100, k: int = 11) -> DataFrame:
    """Top-k neighbourhoods by median price among those with >= min_listings."""
    return (neighbourhood_stats(df).where(F.col("listings") >= min_listings)
            .orderBy(F.desc("median_price"), F.asc("neighbourhood_cleansed")).limit(k))


def priciest_vs_city(df: DataFrame, min_listings: int = 100) -> DataFrame:
    """The top neighbourhood's median against the overall median (ratio - 1)."""
    city = df.select(median(_price())).scalar()
    return (priciest_neighbourhoods(df, min_listings, 1)
            .select("neighbourhood_cleansed", "median_price", city.alias("city_median"))
            .withColumn("vs_city", F.col("median_price") / F.col("city_median") - 1))


def tier_mix_by_room(df: DataFrame) -> DataFrame:
    """Share of each tier inside each room type (shares sum to 1 per room)."""
    counts = df.groupBy("room_type", "price_category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("room_type")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def amenity_premiums(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Median price with minus without each amenity flag; skipped when undefined.

    All medians are conditional aggregates of one pass; the one result row is
    then unpivoted.
    """
    flags = [flag_column(a) for a in cfg.features.key_amenities]
    row = df.agg(*[median(F.when(F.col(f) == v, _price())).alias(f"{f}_{v}") for f in flags for v in (0, 1)])
    out = row.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("amenity"), F.col(f"{f}_1").alias("with_median"), F.col(f"{f}_0").alias("without_median"))
        for f in flags])).alias("r")).select("r.*")
    return (out.where(F.col("with_median").isNotNull() & F.col("without_median").isNotNull())
               .withColumn("premium", F.col("with_median") - F.col("without_median")))


def room_type_counts(df: DataFrame) -> DataFrame:
    """Listings per room type, largest first."""
    return df.groupBy("room_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "room_type")


def neighbourhood_profile(df: DataFrame) -> DataFrame:
    """Deep-dive numbers for every neighbourhood in one grouped pass."""
    city = df.select(median(_price())).scalar()
    keys = ["neighbourhood_cleansed"]
    # Distance is continuous: its median uses the bucketed exact quantile
    # (no whole-group value map); prices and ratings have bounded support.
    dist = exact_quantiles(df, keys, "distance_from_cbd_km", {"median_distance_km": 0.5})
    agg = (df.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("listings"),
                median(_price()).alias("median_price"),
                median("review_scores_rating").alias("median_rating"),
                F.avg("host_is_superhost").alias("superhost_share"))
           .withColumn("vs_city", F.col("median_price") / city - 1))
    return _null_safe_join(agg, dist, keys, "left")


def neighbourhood_tier_mix(df: DataFrame) -> DataFrame:
    """Tier shares per neighbourhood, absent tiers 0 (3 rows per neighbourhood)."""
    counts = df.groupBy("neighbourhood_cleansed", "price_category").agg(F.count(F.lit(1)).alias("n"))
    grid = (df.select("neighbourhood_cleansed").distinct()
              .select("neighbourhood_cleansed",
                      F.explode(F.array(*[F.lit(t) for t in TIER_ORDER])).alias("price_category")))
    w = Window.partitionBy("neighbourhood_cleansed")
    return (_null_safe_join(grid, counts, ["neighbourhood_cleansed", "price_category"], "left")
                .withColumn("n", F.coalesce("n", F.lit(0)))
                .withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(w))))


def comparables(df: DataFrame) -> DataFrame:
    """Per (neighbourhood, room type): n, median, q25, q75, median rating."""
    return df.groupBy("neighbourhood_cleansed", "room_type").agg(
        F.count(F.lit(1)).alias("n"),
        median(_price()).alias("median_price"),
        quantile(_price(), 0.25).alias("q25"),
        quantile(_price(), 0.75).alias("q75"),
        median("review_scores_rating").alias("median_rating"))


def representative_rate(df: DataFrame, min_comps: int = 10) -> DataFrame:
    """Comps median when there are >= min_comps comparables, else the tier midpoint.

    Evaluated for every (neighbourhood, room type, tier) present.
    """
    comps = comparables(df).select("neighbourhood_cleansed", "room_type", "n", "median_price")
    keys = df.select("neighbourhood_cleansed", "room_type", "price_category").distinct()
    mid = F.create_map(*[x for t, v in TIER_MIDPOINTS.items() for x in (F.lit(t), F.lit(v))])
    return (_null_safe_join(keys, comps, ["neighbourhood_cleansed", "room_type"], "left")
                .select("neighbourhood_cleansed", "room_type", "price_category", "n",
                        F.when(F.col("n") >= min_comps, F.col("median_price"))
                         .otherwise(mid[F.col("price_category")]).alias("rate"),
                        (F.col("n") >= min_comps).alias("from_comps")))


def _value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows collapsed to (keys, value, count): a hot value becomes one row."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def comps_standing(df: DataFrame) -> DataFrame:
    """E16 for every listing: share of its comparables priced strictly below it.

    Prices are first collapsed to (group, price, count), so the running
    count is a window over distinct prices per group, not over raw rows.
    """
    keys = ["neighbourhood_cleansed", "room_type"]
    vc = _value_counts(df, keys, "price_numeric")
    w = Window.partitionBy(*keys).orderBy("price_numeric").rowsBetween(Window.unboundedPreceding, -1)
    below = vc.select(*keys, "price_numeric",
                      F.coalesce(F.sum("cnt").over(w), F.lit(0)).alias("below"),
                      F.sum("cnt").over(Window.partitionBy(*keys)).alias("n"))
    return (_null_safe_join(df.select("id", *keys, "price_numeric"), below, keys + ["price_numeric"])
              .select("id", (F.col("below") / F.col("n")).alias("share_below")))


def rate_standing(requests: DataFrame, comps: DataFrame, rate: str = "rate") -> DataFrame:
    """E16 for requests with any rate: (request_id, n, share_below), the share of the request's comparables priced strictly below it.

    Prices and rates of a group go through one ordered stream, the prices
    with their counts and the rates with none, so no request meets a price.
    Without comparables, or without a rate, the share is null.
    """
    keys = ["neighbourhood_cleansed", "room_type"]
    prices = _value_counts(comps.where(F.col("price_numeric").isNotNull()), keys, "price_numeric").withColumnRenamed("price_numeric", "_v")
    asked = requests.where(F.col(rate).isNotNull()).select(*keys, F.col(rate).cast("double").alias("_v"), F.lit(0).cast("long").alias("cnt"))
    stream = prices.withColumn("_v", F.col("_v").cast("double")).unionByName(asked).groupBy(*keys, "_v").agg(F.sum("cnt").alias("cnt"))
    below = sums_before(stream, keys, "_v", {"below": "cnt"}).select(*keys, "_v", "below")
    totals = prices.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    rows = requests.select("request_id", *keys, F.col(rate).cast("double").alias("_v"))
    out = _null_safe_join(_null_safe_join(rows, below, [*keys, "_v"], "left"), totals, keys, "left")
    return out.select("request_id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("below") / F.col("n")).alias("share_below"))


def farther_from_cbd_share(df: DataFrame) -> DataFrame:
    """E17 for every listing: share of all listings strictly farther from the CBD.

    A listing without a distance is farther than none, and none is farther
    than it.  Distances are collapsed to distinct values with counts, whose
    running sums say how many listings are at most as far.
    """
    d = "distance_from_cbd_km"
    counts = _value_counts(df.where(F.col(d).isNotNull()), [], d)
    le = sums_before(counts, [], d, {"nearer": "cnt"}).select(d, (F.col("nearer") + F.col("cnt")).alias("le"))
    n = df.select(F.struct(F.count(F.lit(1)).alias("all"), F.count(d).alias("placed"))).scalar()
    farther = (n.getField("placed") - F.col("le")) / n.getField("all")
    return df.select("id", d).join(le, d, "left").select("id", F.coalesce(farther, F.lit(0.0)).alias("farther_share"))


def superhost_gap(df: DataFrame) -> DataFrame:
    """median(superhost) - median(others); a missing flag counts as 'other'."""
    is_sh = F.coalesce(F.col("host_is_superhost") > 0, F.lit(False))
    out = df.agg(median(F.when(is_sh, _price())).alias("superhost_median"),
                 median(F.when(~is_sh, _price())).alias("other_median"))
    return out.withColumn("gap", F.col("superhost_median") - F.col("other_median"))


def neighbourhood_centroids(df: DataFrame) -> DataFrame:
    """Median latitude and longitude per neighbourhood (exact, bucketed)."""
    keys = ["neighbourhood_cleansed"]
    # Both coordinates in one pass: unpivot, then one exact quantile job keyed by column.
    long = df.select(*keys, "latitude", "longitude").unpivot(keys, ["latitude", "longitude"], "_col", "_val")
    med = exact_quantiles(long, keys + ["_col"], "_val", {"_m": 0.5})
    return med.groupBy(*keys).agg(
        F.first(F.when(F.col("_col") == "latitude", F.col("_m")), ignorenulls=True).alias("latitude"),
        F.first(F.when(F.col("_col") == "longitude", F.col("_m")), ignorenulls=True).alias("longitude"))


def revenue_outlook(rates: DataFrame, availability: Column) -> DataFrame:
    """nights = min(availability, 365); 0.55 / 0.65 / 0.75 occupancy."""
    nights = F.least(availability.cast("long"), F.lit(365))
    return rates.select("*", nights.alias("open_nights")).select(
        "*",
        (F.col("rate") * F.col("open_nights") * 0.65).alias("revenue_est"),
        (F.col("rate") * F.col("open_nights") * 0.55).alias("revenue_low"),
        (F.col("rate") * F.col("open_nights") * 0.75).alias("revenue_high"))


# --------------------------------------------------------------------------- histograms
def histogram(df: DataFrame, value: Column, bins: int, group: list[str] | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of ``value`` (per group if given).

    Bin index = floor((x - lo) * bins / (hi - lo)), last bin right-closed.
    Ungrouped bounds are one scalar subquery.  With groups (null is one),
    rows are first collapsed to distinct values, so the bounds join few rows
    of a frequent group.
    """
    group = group or []
    v = df.select(*group, value.alias("_x")).where(F.col("_x").isNotNull())
    v = v.groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_n"))
    if group:
        bounds = v.groupBy(*group).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        v = _null_safe_join(v, bounds, group)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        b = v.select(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
        lo, hi = b.getField("lo"), b.getField("hi")
    span = hi - lo
    idx = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo) * (F.lit(float(bins)) / span)).cast("int"), F.lit(bins - 1)))
    out = v.select(*group, "_n", idx.alias("bin"),
                   (lo + idx * span / bins).alias("bin_lo"),
                   (lo + (idx + 1) * span / bins).alias("bin_hi"))
    return out.groupBy(*group, "bin", "bin_lo", "bin_hi").agg(F.sum("_n").alias("n"))


def price_histogram(df: DataFrame, bins: int = 60, clip: float = 1500.0) -> DataFrame:
    """Price clipped at a constant, 60 equal bins."""
    return histogram(df, clip_upper(_price(), F.lit(clip)), bins)


def tier_price_histogram(df: DataFrame, bins: int = 40, q: float = 0.98) -> DataFrame:
    """Prices <= p98 of the view, stacked by tier on shared bins."""
    kept = keep_at_most_quantile(df, q)
    b = kept.select(F.struct(F.min(_price()).alias("lo"), F.max(_price()).alias("hi"))).scalar()
    lo, hi = b.getField("lo"), b.getField("hi")
    span = hi - lo
    idx = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((_price() - lo) * (F.lit(float(bins)) / span)).cast("int"), F.lit(bins - 1)))
    return kept.groupBy("price_category", idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def comps_histogram(df: DataFrame, bins: int = 34, q: float = 0.98) -> DataFrame:
    """Per comparable group, prices clipped at the group's p98, <= 34 bins."""
    keys = ["neighbourhood_cleansed", "room_type"]
    caps = df.groupBy(*keys).agg(quantile(_price(), q).alias("_cap"))
    prices = _null_safe_join(_value_counts(df, keys, "price_numeric"), caps, keys)
    clipped = prices.select(*keys, clip_upper(_price(), F.col("_cap")).alias("_x"), "cnt")
    bounds = clipped.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    bin_ = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) * (F.lit(float(bins)) / span)).cast("int"), F.lit(bins - 1)))
    return _null_safe_join(clipped, bounds, keys).groupBy(*keys, bin_.alias("bin")).agg(F.sum("cnt").alias("n"))


def map_sample(df: DataFrame, n: int = 4000, seed: int = 7) -> DataFrame:
    """Deterministic sample of min(n, rows) listings (hash order, exact size)."""
    return (df.withColumn("_h", stable_hash("id", seed))
              .orderBy("_h", "id").limit(n).drop("_h"))
